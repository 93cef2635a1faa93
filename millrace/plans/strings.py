"""String functions over part names, tags and literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import strings as S
from millrace.functions.names import plain
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


def _part(name, column, oracle, key="p_partkey", table="part"):
    """A function of one row: ``column`` here, the SQL expression there, result column v."""
    C.add(f"str_{name}", f"SELECT {key}, {oracle} AS v FROM {table}")(lambda t: getattr(t, table).select(key, (column() if callable(column) else column).alias("v")))


_part("concat", lambda: F.concat("p_name", F.lit("-"), F.col("p_size").cast("string")), "p_name || '-' || CAST(p_size AS VARCHAR)")
_part("concat_null", lambda: F.concat("p_name", F.nullif("p_brand", F.lit("Brand#11"))), "p_name || nullif(p_brand, 'Brand#11')")
_part("concat_ws", lambda: F.concat_ws("|", "p_name", F.nullif("p_brand", F.lit("Brand#11")), "p_type"), "concat_ws('|', p_name, nullif(p_brand, 'Brand#11'), p_type)")
_part("substr", lambda: S.mid("p_name", 3), "substr(p_name, 3)")
_part("substr_from_for", lambda: S.mid("p_name", 2, 4), "substr(p_name, 2, 4)")
_part("substring_negative", lambda: S.mid("p_name", -4), "CASE WHEN length(p_name) < 4 THEN '' ELSE substr(p_name, -4) END")
_part("mid_zero", lambda: S.mid("p_name", 0, 1), "''")
_part("mid_before_start", lambda: S.mid("p_name", -8, 20), "CASE WHEN length(p_name) < 8 THEN '' ELSE substr(p_name, -8) END")
_part("left", lambda: S.left("p_name", 5), "left(p_name, 5)")
_part("left_nonpositive", lambda: S.left("p_name", F.lit(-1)), "''")
_part("right", lambda: S.right("p_name", 5), "right(p_name, 5)")
_part("right_nonpositive", lambda: S.right("p_name", F.lit(0)), "''")
_part("replace", lambda: F.replace("p_name", F.lit("e"), F.lit("33")), "replace(p_name, 'e', '33')")
_part("length", lambda: F.octet_length("p_name"), "strlen(p_name)::INTEGER")
_part("length_bytes", lambda: F.octet_length("text"), "strlen(text)::INTEGER", "doc_id", "documents")
_part("char_length", lambda: F.char_length("text"), "length(text)::INTEGER", "doc_id", "documents")
_part("character_length", lambda: F.character_length("p_type"), "length(p_type)::INTEGER")
_part("char_length_number", lambda: F.char_length(F.col("p_size").cast("string")), "length(CAST(p_size AS VARCHAR))::INTEGER")
_part("ascii", lambda: F.ascii("p_name"), "ascii(p_name)")
_part("ascii_number", lambda: F.ascii(F.col("p_size").cast("string")), "ascii(CAST(p_size AS VARCHAR))")
_part("ord", lambda: S.ord_("p_name"), "ascii(p_name)::BIGINT")
_part("hex", lambda: F.hex("p_brand"), "hex(p_brand)")
_part("hex_number", lambda: F.hex("p_size"), "upper(printf('%x', p_size))")
_part("unhex", lambda: F.unhex(F.hex("p_brand")).cast("string"), "p_brand")
_part("bin", lambda: F.bin("p_size"), "bin(p_size)")
_part("conv", lambda: F.conv(F.col("p_size").cast("string"), 10, 16), "upper(printf('%x', p_size))")
_part("ltrim", lambda: F.ltrim(F.concat(F.lit("  "), F.col("p_name"))), "ltrim('  ' || p_name)")
_part("rtrim", lambda: F.rtrim(F.concat(F.col("p_name"), F.lit("  "))), "rtrim(p_name || '  ')")
_part("trim", lambda: F.trim(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))), "trim(' ' || p_name || ' ')")
_part("upper", lambda: F.upper("p_name"), "upper(p_name)")
_part("lower", lambda: F.lower("p_brand"), "lower(p_brand)")
_part("lcase", lambda: F.lcase("p_type"), "lower(p_type)")
_part("repeat", lambda: F.repeat("p_brand", F.lit(2)), "repeat(p_brand, 2)")
_part("reverse", lambda: F.reverse("p_name"), "reverse(p_name)")
_part("rpad", lambda: F.rpad("p_name", 20, "*"), "rpad(p_name, 20, '*')")
_part("lpad", lambda: F.lpad("p_name", 20, "*"), "lpad(p_name, 20, '*')")
_part("instr", lambda: F.instr("p_name", "a"), "instr(p_name, 'a')::INTEGER")
_part("locate", lambda: F.locate("e", "p_name"), "instr(p_name, 'e')::INTEGER")
_part("insert", lambda: S.insert("p_name", 2, 3, F.lit("##")), "substr(p_name, 1, 1) || '##' || substr(p_name, 5)")
_part("substring_index", lambda: F.substring_index("p_name", " ", 1), "split_part(p_name, ' ', 1)")
_part("strcmp", lambda: S.strcmp("p_name", "p_type"), "CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END")
_part("weight_string", lambda: S.weight_string("p_brand"), "hex(upper(p_brand))")
_part("md5", lambda: F.md5("p_name"), "md5(p_name)")
_part("md5_number", lambda: F.md5(F.col("p_size").cast("string")), "md5(CAST(p_size AS VARCHAR))")
_part("field", lambda: S.field("p_size", 3, 7, 9), "CASE p_size WHEN 3 THEN 1 WHEN 7 THEN 2 WHEN 9 THEN 3 ELSE 0 END")
_part("elt", lambda: S.elt("p_size", "a", "b", "c"), "CASE p_size WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END")
_part("find_in_set", lambda: F.find_in_set(F.col("p_size").cast("string"), F.lit("1,5,9,13")), "coalesce(list_position(['1','5','9','13'], CAST(p_size AS VARCHAR)), 0)::INTEGER")
_part("to_base64", lambda: F.base64(F.encode("p_brand", "UTF-8")), "base64(encode(p_brand))")
_part("space", lambda: F.concat(F.repeat(F.lit(" "), F.col("p_size") % 4), F.lit("|")), "repeat(' ', p_size % 4) || '|'")
_part("plain_form", lambda: plain("hashtag"), "lower(trim(regexp_replace(trim(hashtag), '^[@#]+', '')))", "tweet_id", "hashtag")


# codes of the letters behind the first, then runs of one code become one, the first letter's own included
_CODES = "translate(substr(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), 1, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') || replace(translate(substr(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), '0', '')"
for _n in "123456":
    _CODES = f"regexp_replace({_CODES}, '{_n}+', '{_n}', 'g')"
_part("soundex", lambda: S.soundex("p_name"), f"CASE WHEN length({_CODES}) < 4 THEN upper(left(p_name, 1)) || rpad(substr({_CODES}, 2), 3, '0') ELSE upper(left(p_name, 1)) || substr({_CODES}, 2) END")
# the polynomial division bit by bit
_part(
    "crc32", lambda: F.crc32(F.encode("p_name", "UTF-8")),
    """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)""",
)


@C.add("str_convert_charset", "SELECT p_partkey, hex(p_name) AS v FROM part")
def _(t):
    # ASCII names have the same bytes in GBK
    return t.part.select("p_partkey", F.hex(S.gbk_bytes("p_name")).alias("v"))


@C.add("str_convert_charset_gbk", "SELECT 'C4E3BAC3' AS hello, 'D6D0B9FA' AS china, '3F' AS unknown, 3 AS chars, 9 AS utf8_bytes")
def _(t):
    one = t.spark.range(1)
    return one.select(
        F.hex(S.gbk_bytes(F.lit("你好"))).alias("hello"), F.hex(S.gbk_bytes(F.lit("中国"))).alias("china"), F.hex(S.gbk_bytes(F.lit("😀"))).alias("unknown"),
        F.char_length(F.lit("数据库")).alias("chars"), F.octet_length(F.lit("数据库")).alias("utf8_bytes"),
    )
