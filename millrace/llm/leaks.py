"""p7: passages of held-out items inside scanned pages.

Template canonicalisation: words are folded over the usual misreadings, numbers (digits and
number words) become a typed placeholder, and the windows of two template words are
hash-joined with the windows of the items. An item's templates recur in other items with other
words in their slots, so windows weigh by how few items have them. For each page and item that
share enough, the words are aligned in order - adverts, other columns and broken words may stand
between - and the slots are checked: a passage counts if of twelve consecutive words of the item
enough stand on the page in order, and the words that fill the template's slots are the item's.

How common a window or a word is is counted once, over all items; items with the same words count
as one. While the items' texts together are small they are indexed and broadcast, and the pages are
looked up in that index. Beyond that the same look-up is an equi join: the corpus is read once, the
scan keeps the windows that can be decisive for an item (a bit filter of fixed size tells), and
pages meet items on the windows' hashes. Both ways check the same pairs by the same weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.scans import fold
from millrace.operators.relational import spread_join
from millrace.session import cut, spread
from millrace.sources.tables import table

#: Signs of the texts of all items up to which they are broadcast; above it pages and items are joined.
BROADCAST_SIGNS = 2_000_000
#: Bits of the filter of decisive windows (a power of two); it is broadcast in the join.
FILTER_BITS = 1 << 27
#: A passage: of RUN consecutive words so many are found, and so large a share of the slot words.
RUN, LEAST, SLOT_SHARE = 12, 11, 0.7
#: Words that may stand between two words of a passage (other columns, adverts).
GAP = 60
#: Steps in the item from one undamaged word to the next at most.
STEP = 6
#: Weight of shared windows that makes a page and an item a candidate, in windows that no other
#: item has.
WEIGHT = 2.75
#: Sums of the same weights in another order differ by less.
NEARLY = 1e-6
#: Words of a passage that must stand undamaged (after folding), apart from the shortest where a
#: passage has so many longer ones.
ANCHORS = 5

# Number words of the three languages; they take the placeholder of numbers.
_NUMBERS = """one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred
eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert
uno dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien"""
_NUMBER_FOLDS = frozenset(fold(w) for w in _NUMBERS.split())
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+$")


def template(word: str, folded: str) -> str:
    """The word's form in a template: its fold, or the placeholder of numbers."""
    return "#" if folded in _NUMBER_FOLDS or _DIGITS.match(word) else folded


@lru_cache(maxsize=200_000)
def near(a: str, b: str) -> bool:
    """Whether folded forms a and b are one word, misread, broken or run together with another."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if min(la, lb) < 4:
        return False
    if a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a):
        return True
    most = 1 if max(la, lb) < 8 else 2
    if abs(la - lb) > most:
        return False
    row = list(range(lb + 1))
    for i, x in enumerate(a):
        left, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], min(left + (x != y), row[j] + 1, row[j + 1] + 1)
        if min(row) > most:
            return False
    return row[lb] <= most


def _bare(words: list[str]) -> set[int]:
    """Places of the runs whose long words are too few or too far apart for anchors: there short words count too."""
    out: set[int] = set()
    for a in range(len(words) - RUN + 1):
        long = [i for i in range(a, a + RUN) if len(words[i]) > 3]
        if len(long) < ANCHORS or any(h - i > STEP for i, h in zip(long, long[1:], strict=False)):
            out.update(range(a, a + RUN))
    return out


def read_item(text: str | None) -> tuple[list[str], list[str], list[str]] | None:
    """Words, folded words and template words of an item, or None where it is too short."""
    raw = _WORD.findall((text or "").lower())
    if len(raw) < RUN:
        return None
    folded = [fold(w) for w in raw]
    return raw, folded, [template(w, f) for w, f in zip(raw, folded, strict=True)]


def weight_of(n: int, count: int) -> float:
    """Weight of a window that ``count`` of ``n`` items have."""
    return math.log2(1 + n / count)


def is_slot(n: int, count: int) -> bool:
    """Whether a word fills slots: one item alone has it, or less than a tenth of the items; the rest is template."""
    return count == 1 or count * 10 < n


def decisive(weights: list[tuple[str, float]], least: float) -> tuple[list[tuple[str, float]], float]:
    """Windows of an item that are joined, and the weight that a page must have of them to reach ``least``.

    The commonest windows, whose weights together stay below half of ``least``, are left out of the
    join: they can't decide, and are the ones that many items and pages have.
    """
    left, out = 0.0, []
    for w, x in sorted(weights, key=lambda p: (p[1], p[0])):
        if not out and left + x < least / 2:
            left += x
        else:
            out.append((w, x))
    return out, least - left


class Item:
    """Words of an item, and which of them fill slots."""

    def __init__(self, words: str, slots: set[str]) -> None:
        raw = words.split()
        self.words = [fold(w) for w in raw]
        self.numbers = [bool(_DIGITS.match(w)) for w in raw]
        self.bare = _bare(self.words)
        self.slots = [w in slots for w in self.words]


def terms_of(words: str) -> tuple[set[str], set[str]]:
    """Folded words and template windows (two words with a blank between) of an item."""
    _, folded, templates = read_item(words)
    return set(folded), {" ".join(p) for p in zip(templates, templates[1:], strict=False)}


class Items:
    """Index of all items: windows to items, weights, and the words of each item."""

    def __init__(self, rows: list[tuple[object, str | None]]) -> None:
        keys: dict[str, list] = defaultdict(list)
        for key, text in rows:
            parts = read_item(text)
            if parts is not None:
                keys[" ".join(parts[0])].append(key)
        #: keys of the items with the same words
        self.keys = list(keys.values())
        n = len(keys)
        self.least = WEIGHT * math.log2(1 + n)
        own = [terms_of(words) for words in keys]
        counts = Counter(w for words, _ in own for w in words)
        windows: dict[str, list[int]] = defaultdict(list)
        for i, (_, pairs) in enumerate(own):
            for p in pairs:
                windows[p].append(i)
        self.items = [Item(words, {w for w in folded if is_slot(n, counts[w])}) for words, (folded, _) in zip(keys, own, strict=True)]
        self.postings = {tuple(p.split(" ")): (at, weight_of(n, len(at))) for p, at in windows.items()}

    def candidates(self, windows: set[tuple[str, str]]) -> list[int]:
        """Items that share enough weight of windows with a page."""
        bits: dict[int, float] = defaultdict(float)
        postings = self.postings
        for pair in windows:
            if pair in postings:
                items, weight = postings[pair]
                for i in items:
                    bits[i] += weight
        return [i for i, b in bits.items() if b >= self.least - NEARLY]


class Page:
    """A page's words and where they stand; ``windows`` are those of its template words."""

    def __init__(self, text: str | None) -> None:
        raw = _WORD.findall(text.lower()) if text else []
        self.raw, self.long = raw, len(raw) >= LEAST
        if self.long:
            self.forms = {w: fold(w) for w in set(raw)}
            types = {w: template(w, f) for w, f in self.forms.items()}
            typed = [types[w] for w in raw]
            self.windows = set(zip(typed, typed[1:], strict=False))

    def ready(self) -> Page:
        """With the places of the words, which only pages with candidates need."""
        self.words = [self.forms[w] for w in self.raw]
        self.where: dict[str, list[int]] = defaultdict(list)
        for p, w in enumerate(self.words):
            self.where[w].append(p)
        self.digits = [bool(_DIGITS.match(w)) for w in self.raw]
        return self


def holds(item: Item, page: Page) -> bool:
    """Whether the page holds a passage of the item, slots included."""
    words, where = item.words, page.where
    anchors = []
    for i, w in enumerate(words):
        if len(w) > 3 or i in item.bare:
            anchors += [(p, i) for p in where.get(w, ())]
    if len(anchors) < ANCHORS:
        return False
    anchors.sort()
    best: list[tuple[int, int]] = []  # (length, previous)
    for k, (p, i) in enumerate(anchors):
        length, back = 1, -1
        for j in range(k - 1, -1, -1):
            q, h = anchors[j]
            if p - q > GAP:
                break
            if q < p and 0 < i - h <= STEP and best[j][0] + 1 > length:
                length, back = best[j][0] + 1, j
        best.append((length, back))
    # every chain that can hold a passage is tried, longest first; its anchors are then used up
    left = set(range(len(best)))
    for k in sorted(left, key=lambda k: -best[k][0]):
        if best[k][0] < ANCHORS:
            break
        chain = []
        while k >= 0 and k in left:
            left.discard(k)
            chain.append(anchors[k])
            k = best[k][1]
        chain.reverse()
        if len(chain) < ANCHORS:
            continue
        in_run = max(sum(i <= j < i + RUN for _, j in chain[n:]) for n, (_, i) in enumerate(chain))
        if in_run >= ANCHORS and _passage(item, chain, page.words, page.digits):
            return True
    return False


def _passage(item: Item, chain: list[tuple[int, int]], page: list[str], digits: list[bool]) -> bool:
    words, found, clash = item.words, [False] * len(item.words), [False] * len(item.words)
    ends = [(max(-1, chain[0][0] - 25), max(-1, chain[0][1] - RUN)), *chain, (min(len(page), chain[-1][0] + 25), min(len(words), chain[-1][1] + RUN))]
    for n, (p, i) in enumerate(chain):
        found[i] = True
    for n in range(len(ends) - 1):
        (p, i), (q, h) = ends[n], ends[n + 1]
        if n == 0:  # before the first anchor, backwards
            at = q - 1
            for x in range(h - 1, i, -1):
                for y in range(at, max(p, at - (GAP // 4 if len(words[x]) > 3 else 2)), -1):
                    if near(words[x], page[y]):
                        found[x], at = True, y - 1
                        break
        else:
            at = p + 1
            for x in range(i + 1, h):
                for y in range(at, q if len(words[x]) > 3 else min(q, at + 2)):
                    if near(words[x], page[y]):
                        found[x], at = True, y + 1
                        break
                else:
                    if item.numbers[x] and at < len(page) and digits[at]:
                        clash[x] = True
    slots = item.slots
    for a in range(len(words) - RUN + 1):
        b = a + RUN
        n = sum(found[a:b])
        if n >= LEAST and not any(clash[a:b]):
            s = sum(slots[a:b])
            if s == 0 or sum(f and t for f, t in zip(found[a:b], slots[a:b], strict=True)) >= SLOT_SHARE * s:
                return True
    return False


def search(items: Items, text: str | None) -> list[int]:
    """Items (by place in ``items.keys``) of which the text holds a passage."""
    page = Page(text)
    found = items.candidates(page.windows) if page.long else []
    if not found:
        return []
    page.ready()
    return [i for i in found if holds(items.items[i], page)]


def _hash(window: str) -> int:
    h = xxhash.xxh64_intdigest(window)
    return h - (1 << 64) if h >> 63 else h


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item key, words) of the items that are long enough; case and signs between words are gone."""
    for batch in batches:
        keys, words = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            parts = read_item(text)
            if parts is not None:
                keys.append(i)
                words.append(" ".join(parts[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(words, pa.string())], ["b", "words"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, window) for each word and window of an item, each once."""
    for batch in batches:
        items, terms, kinds = [], [], []
        for i, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for window, own in enumerate(terms_of(words)):
                terms += sorted(own)
                items += [i] * len(own)
                kinds += [bool(window)] * len(own)
        yield pa.RecordBatch.from_pydict({"i": pa.array(items, pa.int64()), "term": pa.array(terms, pa.string()), "window": pa.array(kinds, pa.bool_())})


def _decisive(least: float):
    """A mapInArrow function: (i, windows, weights) to (i, h, x, least), the hashes and weights of the decisive windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, windows, weights in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own, enough = decisive(list(zip(windows, weights, strict=True)), least)
                rows += [(i, _hash(w), x, enough) for w, x in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["i", "h", "x", "least"])

    return run


def _verify(least: float):
    """A mapInArrow function: (row, a, text, i, words, slots, windows, weights) to (a, i) of the pairs that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=1000)(lambda words, slots: Item(words, set(slots)))
        last, page = None, None
        for batch in batches:
            rows, texts, words, slots, windows, weights = (batch.column(c).to_pylist() for c in (0, 2, 4, 5, 6, 7))
            keep = []
            for n, row in enumerate(rows):
                if row != last:  # rows of a page follow one another
                    last, page = row, Page(texts[n]).ready()
                bits = sum(x for w, x in zip(windows[n], weights[n], strict=True) if tuple(w.split(" ")) in page.windows)
                if bits >= least - NEARLY and holds(known(words[n], tuple(slots[n])), page):
                    keep.append(n)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(3).take(at)], ["a", "i"])

    return run


def _joined(pages: DataFrame, own: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """(a, b) of the pages and items that match, by equi joins; the corpus is read once."""
    spark = pages.sparkSession
    own = cut(own.mapInArrow(_words, f"b {kinds[1]}, words string"))
    items = cut(own.select("words").distinct().withColumn("i", F.monotonically_increasing_id()))
    keys = spread_join(own, items, "words").select("i", "b")
    n = items.count()
    least = WEIGHT * math.log2(1 + n)
    terms = cut(items.select("i", "words").mapInArrow(_terms, "i long, term string, window boolean"))
    counts = terms.groupBy("term", "window").agg(F.count(F.lit(1)).alias("c"))
    # the few terms of very many items are joined by broadcast, inside spread_join
    counted = spread_join(terms.withColumn("t", F.struct("term", "window")), counts.select(F.struct("term", "window").alias("t"), "c"), "t").select("i", "t.term", "t.window", "c")
    c = F.col("c")
    facts = cut(
        counted.groupBy("i").agg(
            F.sort_array(F.collect_list(F.when(F.col("window"), F.struct("term", F.log2(1 + F.lit(float(n)) / c).alias("x"))))).alias("w"),
            F.collect_list(F.when(~F.col("window") & ((c == 1) | (c * 10 < n)), F.col("term"))).alias("slots"),
        ).select("i", F.col("w.term").alias("windows"), F.col("w.x").alias("weights"), F.sort_array("slots").alias("slots"))
    )
    need = cut(facts.select("i", "windows", "weights").mapInArrow(_decisive(least), "i long, h long, x double, least double"))
    # one bit for each decisive window; the words of the filter that are not zero, at most FILTER_BITS / 64, come to the driver
    bit = F.pmod("h", F.lit(FILTER_BITS))
    found = need.groupBy(F.floor(bit / 64).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(pmod(h, {FILTER_BITS}L), 64) as int)))").alias("bits")).toArrow()
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(filled)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keep, hits = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                page = Page(text)
                if page.long:
                    h = np.array([_hash(" ".join(p)) for p in page.windows], np.int64)
                    at = h % FILTER_BITS
                    h = h[(bits[at >> 6] >> (at & 63)) & 1 == 1]
                    if len(h):
                        keep.append(n)
                        hits.append(np.sort(h))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hits, pa.list_(pa.int64()))], ["a", "text", "hits"])

    read = cut(spread(pages).mapInArrow(scan, f"a {kinds[0]}, text string, hits array<long>").withColumn("row", F.monotonically_increasing_id()))
    shared_windows = spread_join(read.select("row", F.explode("hits").alias("h")), need, "h")
    pairs = shared_windows.groupBy("row", "i").agg(F.sum("x").alias("x"), F.first("least").alias("least")).where(F.col("x") >= F.col("least") - NEARLY).select("row", "i")
    sides = spread_join(pairs, items.join(facts, "i"), "i")
    both = sides.join(read.select("row", "a", "text"), "row").sortWithinPartitions("row").select("row", "a", "text", "i", "words", "slots", "windows", "weights")
    return both.mapInArrow(_verify(least), f"a {kinds[0]}, i long").join(keys, "i").select("a", "b")


def leaked(pages: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key) for each page that holds a passage of an item.

    Null and empty texts hold nothing; items with fewer than twelve words, null or empty ones are
    never found; null keys come out as they are; of items with the same words each comes out;
    repeated page rows give repeated rows; empty tables give no row. Texts are read whole. Other
    columns are not read. The result does not depend on ``BROADCAST_SIGNS``.
    """
    spark = pages.sparkSession
    kinds = pages.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    pages, own = pages.select(F.col(key).alias("a"), F.col(text).alias("text")), items.select(F.col(item_key).alias("b"), F.col(item_text).alias("t"))
    size = own.agg(F.sum(F.octet_length("t") + 40)).first()[0] or 0
    if size > BROADCAST_SIGNS:
        matched = _joined(pages, own, kinds)
    else:
        shared = spark.sparkContext.broadcast([tuple(r) for r in own.orderBy("b", "t").collect()])
        kind = to_arrow_type(items.schema[item_key].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Items(shared.value)
            for batch in batches:
                rows, found = [], []
                for n, t in enumerate(batch.column(1).to_pylist()):
                    for i in search(index, t):
                        rows += [n] * len(index.keys[i])
                        found += index.keys[i]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, kind)], ["a", "b"])

        matched = spread(pages).mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}")
    return matched.select(F.col("a").alias(key), F.col("b").alias(item_key))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Items by the number of pages that hold a passage of theirs."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_pages"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
ORACLES: dict[str, str] = {}
