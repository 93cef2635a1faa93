"""p4: abusive, hateful or sexual content, by the nearest labelled examples.

Messages are cut into statements; disguises (look-alike letters, masks, split or stretched words,
swapped letters) are undone against the words of the labelled examples. Each statement is a query
against the statements of the labelled examples: exact TF-IDF cosine over words and word pairs,
through an inverted index whose postings carry, for each block of examples, the largest weight.
The block maxima bound the cosine that an unwanted example can reach; statements that can't reach
MIN_COSINE have no evidence and score 0 without reading any posting, and blocks that can't are
skipped for the rest, so the result equals the full search. The votes of the NEIGHBOURS nearest
examples, weighted by the squared cosine, are the score of a statement, the largest score of its
statements that of a message. Scores are calibrated on labelled messages that were scored by the
others; the calibrated probability decides.

The classifier is fitted on a bounded sample of the labelled rows (SAMPLE); everything else reads
every row and the whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import plain
from millrace.llm.sampling import bounded_sample
from millrace.session import spread
from millrace.sources.tables import table

#: Labelled rows that the classifier is fitted on at most (those with the smallest hash of the id).
SAMPLE = 10_000
NEIGHBOURS = 15
MIN_COSINE = 0.35
#: Share of the nearest example's cosine that the other neighbours need.
CLOSE = 0.6
#: Calibrated probability from which a message is unwanted, and parts that the examples are cut into for the calibration.
THRESHOLD, FOLDS = 0.5, 3
BLOCK = 64
#: Rounds of editing the examples at most, the count that a term's odds start with, what the sum
#: of the odds counts for (neighbouring pairs repeat one another), and the log odds of a label.
ROUNDS, SMOOTH, DAMP, LABEL = 8, 0.3, 0.6, 6.0
#: Examples that must have a term, and the weight in the norm of a word that fewer have.
LEAST_DF, OTHER = 2, 1.5
#: Entries of a worker's memo of statements and words before it is dropped.
MEMO = 200_000

# Letters of other scripts that look like Latin ones, and signs used for letters.
_ALIKE = str.maketrans("авеѕіјкмнорсԁтухѵαβεικνορτυχ", "abesijkmhopcdtyxvabeiknoptux")
_SIGNS = str.maketrans("013457$@!+|", "oieastsaitl")
_DROP = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xFE0F)} | {c: None for c in range(0x300, 0x370)}

_NOISE = re.compile(r"https?://\S+|(?<![^\s(,;:!?])[@#][\w.\-]*|^\s*rt\s+|&\w+;")
_CUT = re.compile(r"[.!?:;…]+(?:\s+|$)|\n|\s(?:--?|>>)\s")
_SPLIT_WORD = re.compile(r"(?<![^\W_])(?:[^\W\d_][._\-*\s]){3,}[^\W\d_](?![^\W_])|(?<![^\W_])(?:[^\W_][._\-]){2,}[^\W_](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_]\s){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_](?:[\w$@!+*'’|]*[\w*])?")
_STRETCH = re.compile(r"(.)\1{2,}")
# Fixed value: words of one letter in the three languages; they may stand beside a word split by blanks.
_ONE = frozenset("aeiouy")


def clean(message: str) -> str:
    """Lower case in plain letters, without handles, tags, links and the mark of a copy."""
    if not message.isascii():
        message = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", message)).lower().replace("ß", "ss").translate(_DROP).translate(_ALIKE)
    else:
        message = message.lower()
    return _NOISE.sub(" ", message)


def statements(message: str) -> list[str]:
    """The statements of a message, in order; blank ones are left out."""
    return [s for s in (" ".join(p.split()) for p in _CUT.split(clean(message))) if s]


class Examples:
    """Block-max inverted index over the statements of labelled messages."""

    def __init__(self, rows: list[tuple[int, str, int]]) -> None:
        raw = []
        for i, m, y in rows:
            own = statements(m)
            # a label of one statement is its own; of several, an unwanted label holds for one of them
            raw += [(i, y, s, -LABEL if y == 0 else LABEL if len(own) == 1 else 0.0) for s in own]
        seen = Counter(w for _, _, s, _ in raw for w in _TOKEN.findall(s) if w.isalpha())
        self.known = {w for w, n in seen.items() if n > 1}
        self._repairs()
        for w in [w for w in self.known if self._repair(w, True) != w and seen[w] * 20 < seen[self._repair(w, True)]]:
            self.known.discard(w)  # a disguise that came twice
        self._repairs()
        docs: dict[tuple[str, ...], list] = {}
        for i, y, s, e in raw:
            terms = self.terms(s)
            if terms:
                d = docs.setdefault(tuple(sorted(terms)), [0, 0, i, 0.0])
                d[y] += 1
                d[3] += e
                d[2] = min(d[2], i)
        keys = list(docs)
        df = Counter(t for k in keys for t in set(k))
        n = len(keys)
        # terms of a single example are names and fillers of slots: they say nothing of the statement
        self.idf = {t: math.log(1 + n / c) for t, c in df.items() if c >= LEAST_DF}
        share = self._edit(keys, docs)
        self._index(keys, docs, share)
        self.memo: dict[str, float] = {}

    @staticmethod
    def _edit(keys: list, docs: dict) -> dict:
        """Side of each statement: 1 unwanted, 0 not.

        Labels hold for whole messages, so fillers beside an unwanted statement come in as unwanted,
        and some labels are wrong. What the own labels say is added to what the odds of the terms say
        in the other examples; sides and odds are found in turn until nothing changes.
        """
        share = {k: docs[k][1] / (docs[k][0] + docs[k][1]) for k in keys}
        size = {k: docs[k][0] + docs[k][1] for k in keys}
        for _ in range(ROUNDS):
            bad, good = Counter(), Counter()
            for k in keys:
                for t in k:
                    bad[t] += size[k] * share[k]
                    good[t] += size[k] * (1 - share[k])
            n_bad = sum(size[k] * share[k] for k in keys) + 1
            n_good = sum(size[k] * (1 - share[k]) for k in keys) + 1
            prior = math.log(n_bad / n_good)
            new = {}
            for k in keys:
                b, g, total = size[k] * share[k], size[k] * (1 - share[k]), 0.0
                for t in k:
                    x, y = bad[t] - b, good[t] - g
                    if x + y > 0.5:
                        total += math.log((x + SMOOTH) / n_bad) - math.log((y + SMOOTH) / n_good)
                new[k] = float(prior + docs[k][3] + DAMP * total > 0)
            if new == share:
                break
            share = new
        return share

    def _repairs(self) -> None:
        self.swapped: dict[tuple[str, str], str] = {}
        self.ends: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.known):
            if len(w) > 3:
                self.swapped[w[0], "".join(sorted(w))] = w
            if len(w) > 2:
                self.ends[w[0]].append(w)
        self.words: dict[str, str] = {}

    def _repair(self, w: str, force: bool = False) -> str:
        """The known word that a token disguises, else the token in plain letters."""
        if w in self.known and not force:
            return w
        if "*" in w:
            pattern = re.compile("".join("[a-z]{1,3}" if p[0] == "*" else re.escape(p) for p in re.findall(r"\*+|[^*]+", w.translate(_SIGNS))))
            return next((k for k in self.ends.get(w[0], ()) if pattern.fullmatch(k)), w)
        if w.isdigit():
            return "#"
        t = w.translate(_SIGNS) if not w.isalpha() else w
        for c in (t, _STRETCH.sub(r"\1", t), _STRETCH.sub(r"\1\1", t), t.replace("v", "u")):
            if c in self.known and c != w:
                return c
        return self.swapped.get((t[0], "".join(sorted(t))), t) if len(t) > 3 and not force else self.swapped.get((t[0], "".join(sorted(t))), t)

    def _unspaced(self, letters: str) -> str:
        """The words of a run of single letters: the known word, or the fewest known ones, else one word."""
        if self._repair(letters) in self.known:
            return letters
        best: list[list[str] | None] = [[]]
        for j in range(1, len(letters) + 1):
            ways = [[*best[i], letters[i:j]] for i in range(j) if best[i] is not None and (letters[i:j] in _ONE or (j - i > 2 and self._repair(letters[i:j]) in self.known))]
            best.append(min(ways, key=len, default=None))
        return " ".join(best[-1] or [letters])

    def terms(self, statement: str) -> set[str]:
        """Words (disguises undone) and pairs of neighbouring words, each once."""
        statement = _SPACED.sub(lambda m: self._unspaced("".join(m[0].split())), statement)
        if "." in statement or "-" in statement or "_" in statement or "*" in statement:
            statement = _SPLIT_WORD.sub(lambda m: re.sub(r"[\W_]", "", m[0]), statement)
        known, words, out = self.known, self.words, []
        for w in _TOKEN.findall(statement):
            if w not in known:
                r = words.get(w)
                if r is None:
                    if len(words) > MEMO:
                        words.clear()
                    r = words[w] = self._repair(w)
                w = r
            out.append(w)
        return {*out, *map(" ".join, zip(out, out[1:], strict=False))}

    def _weight(self, term: str) -> float:
        w = self.idf.get(term)
        return w if w is not None else 0.0 if " " in term else OTHER

    def _index(self, keys: list, docs: dict, share: dict) -> None:
        # unwanted examples first, so that blocks differ and the bound of their blocks is tight
        self.order = sorted(keys, key=lambda k: (-share[k], k))
        self.share = np.array([share[k] for k in self.order])
        self.weight = np.array([min(4, docs[k][0] + docs[k][1]) for k in self.order], float)
        self.source = [docs[k][2] for k in self.order]
        bad = int((self.share > 0.5).sum())
        self.bad_blocks = -(-bad // BLOCK)
        post: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for j, k in enumerate(self.order):
            norm = math.sqrt(sum(self._weight(t) ** 2 for t in k)) or 1.0
            for t in k:
                if t in self.idf:
                    post[t][0].append(j)
                    post[t][1].append(self.idf[t] / norm)
        self.post, self.blocks, self.bound = {}, {}, {}
        for t, (d, w) in post.items():
            d, w = np.array(d), np.array(w)
            b, at = np.unique(d // BLOCK, return_index=True)
            self.post[t], self.blocks[t] = (d, w), (b, np.maximum.reduceat(w, at))
            unwanted = w[d < bad]
            idf = self.idf[t]
            self.bound[t] = (idf * idf, float(unwanted.max()) * idf if len(unwanted) else 0.0)

    def _near(self, terms: Iterable[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The nearest examples and their cosines, or None where no unwanted one can reach MIN_COSINE."""
        norm2 = bound = 0.0
        known, idf = self.bound, self.idf
        for t in terms:
            w = known.get(t)
            if w is not None:
                norm2 += w[0]
                bound += w[1]
            elif " " not in t:
                norm2 += OTHER * OTHER
        norm = math.sqrt(norm2)
        if bound == 0.0 or bound < MIN_COSINE * norm:
            return None
        hit = sorted(t for t in terms if t in known)
        top = np.bincount(np.concatenate([self.blocks[t][0] for t in hit]), np.concatenate([self.blocks[t][1] * idf[t] for t in hit]), -(-len(self.order) // BLOCK))
        alive = top >= MIN_COSINE * norm
        if not alive[: self.bad_blocks].any():
            return None
        d = np.concatenate([self.post[t][0] for t in hit])
        w = np.concatenate([self.post[t][1] * idf[t] for t in hit])
        keep = alive[d // BLOCK]
        cosine = np.bincount(d[keep], w[keep], len(self.order)) / norm
        near = np.flatnonzero(cosine >= max(MIN_COSINE, CLOSE * cosine.max()))
        if not len(near):
            return None
        if len(near) > NEIGHBOURS:
            near = near[np.argpartition(-cosine[near], NEIGHBOURS - 1)[:NEIGHBOURS]]
        return near, cosine[near]

    def _search(self, terms: Iterable[str]) -> float | None:
        """Weighted vote of the nearest examples, or None where no unwanted one can reach MIN_COSINE."""
        found = self._near(terms)
        if found is None:
            return None
        near, cosine = found
        v = cosine**2 * self.weight[near]
        return float((v * self.share[near]).sum() / v.sum())

    def evidence(self, message: str | None, most: int = 3) -> tuple[str, list[tuple[int, float]]] | None:
        """The statement of a message with the highest score, and the labelled messages that speak for it."""
        best = max(((self._search(self.terms(s)) or 0.0, s) for s in (statements(message) if message else ())), default=(0.0, ""))
        if best[0] <= 0:
            return None
        near, cosine = self._near(self.terms(best[1]))
        rank = sorted((-c, j) for j, c in zip(near, cosine, strict=True) if self.share[j] > 0.5)
        return best[1], [(self.source[j], round(float(-c), 4)) for c, j in rank[:most]]

    def score(self, message: str | None) -> float:
        """Score of a message, 0 to 1; null, empty and blank ones have 0."""
        best = 0.0
        memo = self.memo
        for s in statements(message) if message else ():
            v = memo.get(s)
            if v is None:
                if len(memo) > MEMO:
                    memo.clear()
                v = memo[s] = self._search(self.terms(s)) or 0.0
            if v > best:
                best = v
        return best


def calibration(rows: list[tuple[int, str, int]]) -> tuple[float, float]:
    """Slope and intercept of the log odds of being unwanted, as a line over the score.

    Each part of the sample is scored by the rest; the line is fitted to those scores and their labels
    by maximum likelihood (most scores are near 0 or 1, too few lie between for a free curve). One
    label at 0 and one at 1 are added, so that the line is defined without any; it never falls.
    """
    x, y = [0.0, 1.0], [0.0, 1.0]
    for f in range(FOLDS):
        e = Examples([r for i, r in enumerate(rows) if i % FOLDS != f])
        for _, m, label in rows[f::FOLDS]:
            x.append(e.score(m))
            y.append(float(label))
    points, labels = np.stack([np.array(x), np.ones(len(x))], 1), np.array(y)
    line = np.zeros(2)
    for _ in range(50):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-points @ line))
        step = np.linalg.solve(points.T @ (points * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), points.T @ (labels - p) - 0.1 * line)
        line = line + step
        if abs(step).max() < 1e-9:
            break
    return max(0.0, float(line[0])), float(line[1])


class Classifier:
    """Fitted examples and their calibration."""

    def __init__(self, rows: list[tuple[int, str, int]]) -> None:
        self.examples = Examples(rows)
        self.slope, self.intercept = calibration(rows)

    def probability(self, score):
        """Probability of being unwanted at a score (a number or an array)."""
        return 1 / (1 + np.exp(-(self.slope * np.asarray(score) + self.intercept)))


@lru_cache(maxsize=4)
def _fitted(rows: tuple[tuple[int, str, int], ...]) -> Classifier:
    return Classifier(list(rows))


def fitted(rows: list[tuple[int, str, int]]) -> Classifier:
    """The classifier of these labelled messages; fitted once, with empty memos."""
    c = _fitted(tuple(rows))
    c.examples.memo, c.examples.words = {}, {}
    return c


def labelled(messages: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, sample: int = SAMPLE) -> list[tuple[int, str, int]]:
    """The sample that the classifier is fitted on: at most ``sample`` labelled rows with a message.

    Null labels are left out; of several messages of a key the longest is taken.
    """
    chosen = bounded_sample(labels.where(F.col(label).isin(0, 1)).select(F.col(label_key).alias("k"), F.col(label).alias("y")), "k", sample)
    own = messages.select(F.col(key).alias("k"), F.col(text).alias("m")).where(F.col("m").isNotNull())
    rows = own.join(F.broadcast(chosen), "k").groupBy("k").agg(F.max(F.struct(F.length("m"), "m"))["m"].alias("m"), F.max("y").alias("y"))
    return sorted((r["k"], r["m"], r["y"]) for r in rows.collect())


def score_messages(messages: DataFrame, key: str, text: str, examples: list[tuple[int, str, int]]) -> DataFrame:
    """(key, score, probability) of every row: the vote and its calibrated probability. No shuffle; rows
    with null or empty messages have score 0."""
    shared = messages.sparkSession.sparkContext.broadcast(fitted(examples))
    kind = messages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            scores = np.array([c.examples.score(m) for m in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(c.probability(scores))], ["key", "score", "probability"])

    return spread(messages.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"key {kind}, score double, probability double").withColumnRenamed("key", key)


def _labelled(spark: SparkSession, d: str) -> list[tuple[int, str, int]]:
    return labelled(table(spark, d, "tweet"), "id", "message", table(spark, d, "tweet_label"), "tweet_id", "unwanted")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score_messages(table(spark, d, "tweet"), "id", "message", _labelled(spark, d)).where(F.col("id").isNotNull())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("probability") >= THRESHOLD).select(F.col("id").alias("tweet_id")).distinct()


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every tweet id (the largest of its rows) and the calibrated probability of being unwanted."""
    return _scored(spark, d).groupBy(F.col("id").alias("tweet_id")).agg(F.max("score").alias("score"), F.max("probability").alias("probability"))


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """For each row of an unwanted tweet the statement that counts and the labelled tweets nearest to it."""
    shared = spark.sparkContext.broadcast(fitted(_labelled(spark, d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            ids, messages = b.column(0).to_pylist(), b.column(1).to_pylist()
            unwanted = [(k, m) for k, m in zip(ids, messages, strict=True) if k is not None and c.probability(c.examples.score(m)) >= THRESHOLD]
            rows = [(k, *e) for k, m in unwanted if (e := c.examples.evidence(m)) is not None]
            yield pa.RecordBatch.from_pydict(
                {"tweet_id": pa.array([r[0] for r in rows], pa.int64()), "statement": pa.array([r[1] for r in rows], pa.string()), "examples": pa.array([[i for i, _ in r[2]] for r in rows], pa.list_(pa.int64())), "cosines": pa.array([[x for _, x in r[2]] for r in rows], pa.list_(pa.float64()))}
            )

    return spread(table(spark, d, "tweet").select("id", "message")).mapInArrow(run, "tweet_id long, statement string, examples array<long>, cosines array<double>")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Tweets and share of unwanted ones of each author (plain form; null for none)."""
    authors = table(spark, d, "tweet").where(F.col("id").isNotNull()).groupBy(F.col("id").alias("tweet_id")).agg(F.min(plain("author")).alias("author"))
    return (
        p4_scores(spark, d)
        .join(authors, "tweet_id")
        .groupBy("author")
        .agg(F.count(F.lit(1)).alias("n_tweets"), F.avg((F.col("probability") >= THRESHOLD).cast("double")).alias("unwanted_rate"))
    )


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores, "p4_evidence": p4_evidence, "p4_rates": p4_rates}
ORACLES: dict[str, str] = {}
