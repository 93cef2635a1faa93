"""Delimited text: LOAD DATA and SELECT ... INTO OUTFILE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TooManyRejects(ValueError):
    """More bad rows than the load allows."""


#: Stand-ins for escaped signs while a line is cut (noncharacters, which no text may hold).
_STAND = "".join(map(chr, range(0xFDD0, 0xFDDA)))
# Letters behind the escape sign and the signs that they stand for.
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\x1a", "0": "\0"}


def _hide(line: Column, sep: str, quote: str, escape: str) -> Column:
    """The line with a stand-in for every escaped sign."""
    pairs = [escape, sep, *([quote] if quote else ())]
    for stand, sign in zip(_STAND, pairs, strict=False):  # the escape sign first, so that runs of it pair up
        line = F.replace(line, F.lit(escape + sign), F.lit(stand))
    for stand, letter in zip(_STAND[3:], _LETTERS, strict=False):
        line = F.replace(line, F.lit(escape + letter), F.lit(stand))
    return line


def _show(field: Column, sep: str, quote: str, escape: str) -> Column:
    """The field with the signs themselves; an escape sign before any other sign falls away."""
    field = F.translate(F.replace(field, F.lit(escape), F.lit("")), _STAND[0] + _STAND[2:8], escape + (quote or _STAND[2]) + "".join(_LETTERS.values())[:5])
    for stand, sign in ((_STAND[1], sep), (_STAND[8], "\0")):  # more than one sign, and a sign that translate takes for none
        field = F.replace(field, F.lit(stand), F.lit(sign))
    return field


def load(
    spark: SparkSession, path: str, schema: T.StructType, *, sep: str = "\t", quote: str = "", line: str | None = None, escape: str = "\\", null: str = "\\N", skip: int = 0, multiline: bool = False,
    columns: list[str] | None = None, defaults: dict[str, Column] | None = None, set_: dict[str, Column] | None = None, reject_path: str | None = None, abort_count: int | None = None, abort_share: float | None = None, seen: Observation | None = None,
) -> DataFrame:
    """LOAD DATA INFILE.

    ``columns``: the file's columns, if they are not all of the schema's; the others take
    ``defaults`` (else NULL). ``set_``: values computed from the file's columns (read as text
    where they are no column of the schema). ``skip``: lines ignored at the start of each file.
    Bad rows (a value that does not fit its type, too few or too many fields) are left out, counted
    in ``seen`` (metrics ``rows`` and ``bad``, known after the first action), and written to
    ``reject_path`` if given; TooManyRejects is raised at ``abort_count`` bad rows or more (0: at the
    first) or at ``abort_share`` of all rows or more. Empty files give no row.

    ``escape`` (one sign) before n, r, t, b, Z or 0 stands for a line end, carriage return, tab,
    backspace, Control-Z or NUL, before any other sign for that sign; ``export`` writes so. Only the
    ``null`` mark is NULL, an empty field is an empty string. A quoted field may hold separators and
    doubled quotes; one that holds bare line ends needs ``multiline``, which reads each file in one
    task and knows no ``skip``.
    """
    if len(escape) != 1:
        raise ValueError("escape must be one sign")
    names = columns or schema.fieldNames()
    kinds = [schema[c].dataType if c in schema.fieldNames() and not (set_ and c in set_) else T.StringType() for c in names]
    texts = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": sep, "quote": quote or "\x01", "escape": quote or "\x01", "mode": "PERMISSIVE", "nullValue": _STAND[9], "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    if multiline:
        if skip:
            raise ValueError("skip needs lines")
        read = spark.read.schema(T.StructType([*texts, T.StructField("_bad", T.StringType())])).options(**options | {"multiLine": "true", "columnNameOfCorruptRecord": "_bad"}).csv(path)
        raw = F.array(*[F.coalesce(_hide(F.coalesce(f.name, F.lit("")), sep, quote, escape), F.lit("")) for f in texts])
        text = read.select(F.coalesce("_bad", F.concat_ws(sep, *texts.fieldNames())).alias("value"), F.when(F.col("_bad").isNull(), raw).alias("r"), F.lit(True).alias("esc"))
    else:
        text = (spark.read.option("lineSep", line) if line else spark.read).text(path)
        if skip:
            # the first block of a file holds its first lines; their numbers rise inside the block
            at = text.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"))
            first = at.where("_b = 0").groupBy("_f").agg(F.min("_n").alias("_first"))
            text = at.join(first, "_f", "left").where((F.col("_b") > 0) | (F.col("_n") >= F.col("_first") + skip)).select("value")
        hidden = F.when(F.instr("value", escape) > 0, _hide(F.col("value"), sep, quote, escape)).otherwise(F.col("value"))
        cut = F.split(F.col("h"), sep if len(sep) == 1 and (sep.isalnum() or sep.isspace()) else "\\" + sep if len(sep) == 1 else f"\\Q{sep}\\E", -1)
        if quote:
            # one field more is read, so that a row with too many fields shows
            csv = F.from_csv(F.col("h"), ", ".join(f"f{i} string" for i in range(len(names) + 1)), options)
            held = F.array(*[F.coalesce(csv[f"f{i}"], F.lit("")) for i in range(len(names))])
            cut = F.when(F.instr("h", quote) > 0, F.when(csv[f"f{len(names)}"].isNull(), held)).otherwise(cut)
        text = text.select("value", hidden.alias("h"), (F.instr("value", escape) > 0).alias("esc")).select("value", "esc", cut.alias("r"))
    fits = F.coalesce(F.size("r") == len(names), F.lit(False))
    field = lambda i: F.when(fits & (F.col("r")[i] != null), F.when(F.col("esc"), _show(F.col("r")[i], sep, quote, escape)).otherwise(F.col("r")[i]))
    rows = text.select("value", fits.alias("fits"), *[field(i).alias(f"t{i}") for i in range(len(names))])
    typed = [F.col(f"t{i}") if isinstance(t, T.StringType) else F.col(f"t{i}").try_cast(t) for i, t in enumerate(kinds)]
    bad = ~F.col("fits")
    for i, v in enumerate(typed):
        if not isinstance(kinds[i], T.StringType):
            bad = bad | (F.col(f"t{i}").isNotNull() & v.isNull())
    # a generator, so that the filter on bad rows is not pushed below and does all the work again
    parsed = rows.select(F.inline(F.array(F.struct(*[v.alias(c) for c, v in zip(names, typed, strict=True)], F.when(bad, F.col("value")).alias("_bad")))))
    if seen is not None:
        parsed = parsed.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("_bad").alias("bad"))
    if reject_path or abort_count is not None or abort_share is not None:
        facts = parsed.agg(F.count(F.lit(1)).alias("n"), F.count("_bad").alias("bad")).first()
        if abort_count is not None and facts["bad"] > 0 and facts["bad"] >= abort_count or abort_share is not None and facts["bad"] > 0 and facts["bad"] >= abort_share * facts["n"]:
            raise TooManyRejects(f"{facts['bad']} of {facts['n']} rows")
        if reject_path:
            parsed.where(F.col("_bad").isNotNull()).select("_bad").write.mode("overwrite").text(reject_path)
    good = parsed.where(F.col("_bad").isNull()).drop("_bad")
    out = []
    for f in schema.fields:
        value = (set_ or {}).get(f.name)
        if value is None:
            value = F.col(f.name) if f.name in names else (defaults or {}).get(f.name, F.lit(None))
        out.append(value.cast(f.dataType).alias(f.name))
    return good.select(*out)


def export(df: DataFrame, path: str, *, sep: str = "\t", quote: str = "", escape: str = "\\", null: str = "\\N", types: dict[str, str] | None = None) -> None:
    """SELECT ... INTO OUTFILE: one file for each task, one line for each row; reading it with ``load`` gives the rows back.

    Separators, quotes, line ends, NUL and the escape sign inside a value are escaped. ``quote``
    encloses text. ``types``: columns that are cast before they are written. The few noncharacters
    that ``load`` uses as stand-ins are an error.
    """
    if len(escape) != 1:
        raise ValueError("escape must be one sign")

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`").cast((types or {}).get(f.name, f.dataType))
        v = c.cast("string")
        if not isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType)) and (types or {}).get(f.name) != "string":
            return F.coalesce(v, F.lit(null))
        w = F.when(v.rlike("[\uFDD0-\uFDDA]"), F.raise_error(F.lit(f"{f.name}: noncharacter"))).otherwise(F.replace(v, F.lit(escape), F.lit(escape * 2)))
        for sign, mark in [(sep, sep), ("\n", "n"), ("\r", "r"), ("\0", "0"), *([(quote, quote)] if quote else ())]:
            w = F.replace(w, F.lit(sign), F.lit(escape + mark))
        w = F.when(w == null, F.concat(F.lit(escape), w)).otherwise(w)
        odd = v.rlike(f"[\\n\\r\\x00\uFDD0-\uFDDA]|\\Q{escape}\\E|\\Q{sep}\\E" + (f"|\\Q{quote}\\E" if quote else "")) | (v == null)
        w = F.when(odd, w).otherwise(v)
        return F.coalesce(F.concat(F.lit(quote), w, F.lit(quote)) if quote else w, F.lit(null))

    df.select(F.concat_ws(sep, *[text(f) for f in df.schema]).alias("value")).write.mode("overwrite").text(path)
