"""p4, p5, p7 and p8: held-out accuracy on invented texts, and odd input."""

import random

import pytest

from millrace.llm import abuse, leaks, privacy, scans, stuffing
from millrace.llm.sampling import bounded_sample

# --- p4 ---

GOOD = ["the {n} by the river is open again", "we walked to the {n} today", "my dog is such an idiot", "the doctor spoke about breast {n} screening", "who painted the {n}", "bloody cold at the {n}"]
BAD = ["you are a filthy idiot", "get lost you stupid idiot nobody wants you", "all foreigners are vermin", "i will break your legs you idiot", "send me naked pictures you slut"]
NOUNS = ["mill", "gate", "bakery", "school", "bridge", "cancer", "harbour", "lamp"]


def labelled(seed, n=600):
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad = r.random() < 0.25
        text = r.choice(GOOD).format(n=r.choice(NOUNS))
        if bad:
            text = r.choice([f"{text}. {r.choice(BAD)}", r.choice(BAD)])
        y = int(bad) if r.random() > 0.02 else 1 - int(bad)
        out.append((i, text + r.choice(["", " @someone", " #tag", " http://x.example/1"]), y))
    return out


@pytest.fixture(scope="module")
def examples():
    return abuse.Examples(labelled(1))


def test_held_out_accuracy(examples):
    r = random.Random(9)
    good = [r.choice(GOOD).format(n=r.choice(NOUNS)) for _ in range(200)]
    bad = [f"{r.choice(GOOD).format(n=r.choice(NOUNS))}. {r.choice(BAD)}" for _ in range(200)]
    assert sum(examples.score(m) >= abuse.THRESHOLD for m in good) <= 4
    assert sum(examples.score(m) >= abuse.THRESHOLD for m in bad) >= 190


@pytest.mark.parametrize("text", ["you are a filthy i**ot", "you are a fi­lthy idiot", "YOU ARE A FILTHY IDIOOOOT", "you are a filthy 1diot", "you are a filthy i.d.i.o.t", "you are a filthy ｉｄｉｏｔ", "you are a filthy iidot", "yоu are a filthy idiоt", "RT @x: you are a filthy idiot!!! #fun"])
def test_disguises(examples, text):
    assert examples.score(text) >= abuse.THRESHOLD


@pytest.mark.parametrize(("split", "whole"), [("you are a filthy i d i o t", "you are a filthy idiot"), ("all foreigners are V E R M I N", "all foreigners are vermin"), ("you are a i d i o t", "you are a idiot"), ("i d i o t s l u t", "idiot slut"), ("plan b c d e is open", "plan bcde is open"), ("v e r m i n", "vermin")])
def test_words_split_by_blanks(examples, split, whole):
    assert examples.terms(abuse.clean(split)) == examples.terms(abuse.clean(whole))
    assert examples.score(split) == examples.score(whole)


@pytest.mark.parametrize("text", [None, "", "   ", "😀😀", "@you", "#a #b", "http://x.example"])
def test_nothing_to_score(examples, text):
    assert examples.score(text) == 0.0


def test_block_max_equals_full_search(examples):
    import math

    e = examples
    rows = [(set(k), math.sqrt(sum(e._weight(t) ** 2 for t in k))) for k in e.order]
    r = random.Random(3)
    for _ in range(150):
        s = f"{r.choice(GOOD + BAD).format(n=r.choice(NOUNS))} {r.choice(['', 'now', 'idiot', 'the mill'])}"
        terms = e.terms(abuse.clean(s))
        norm = math.sqrt(sum(e._weight(t) ** 2 for t in terms))
        cos = [sum(e.idf.get(t, 0) ** 2 for t in terms if t in k) / norm / (n or 1) for k, n in rows]
        best = max(cos)
        near = sorted((i for i, c in enumerate(cos) if c >= max(abuse.MIN_COSINE, abuse.CLOSE * best)), key=lambda i: -cos[i])
        got = e._search(terms)
        if not any(e.share[i] > 0.5 and cos[i] >= abuse.MIN_COSINE for i in range(len(cos))):
            assert not got  # no unwanted example near enough: no evidence
        elif len(near) <= abuse.NEIGHBOURS and got is not None:
            v = [cos[i] ** 2 * e.weight[i] for i in near]
            assert got == pytest.approx(sum(x * e.share[i] for x, i in zip(v, near)) / sum(v))


def test_evidence_and_calibration(examples):
    statement, near = examples.evidence("the mill is open. you are a filthy idiot")
    assert statement == "you are a filthy idiot" and near and all(c >= abuse.MIN_COSINE for _, c in near)
    by_id = {i: m for i, m, _ in labelled(1)}
    assert all(any(w in by_id[i] for w in ("idiot", "filthy")) for i, _ in near)
    assert examples.evidence("the mill is open") is None and examples.evidence(None) is None
    slope, intercept = abuse.calibration(labelled(1))
    at = lambda x: 1 / (1 + 2.718281828 ** -(slope * x + intercept))
    assert slope > 0 and at(0.0) < 0.2 and at(1.0) > 0.8 and at(0.2) < at(0.4)
    assert len(abuse.calibration([])) == 2
    c = abuse.fitted(labelled(1))
    assert c is abuse.fitted(labelled(1)) and c.probability(0.0) < 0.2 and c.probability(1.0) > 0.8
    assert abuse.Classifier([]).probability(0.0) < 0.5


def test_scores_of_rows(spark, examples):
    df = spark.createDataFrame([(1, "you are a filthy idiot", 0.5), (2, None, 0.1), (None, "", 0.2), (1, "the mill is open", 0.3)], "id long, message string, score double")
    got = abuse.score_messages(df, "id", "message", labelled(1)).collect()
    assert len(got) == 4 and max(r["score"] for r in got if r["id"] == 1) >= 0.5
    assert {(r["id"], r["probability"] >= 0.5) for r in got} == {(1, True), (1, False), (2, False), (None, False)}
    assert abuse.score_messages(df.limit(0), "id", "message", []).count() == 0


def test_labels_are_bounded_and_clean(spark):
    tweets = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(1, "a longer text 1"), (2, None)], "id long, message string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(90, 1), (3, None)], "tweet_id long, unwanted int")
    rows = abuse.labelled(tweets, "id", "message", labels, "tweet_id", "unwanted", sample=20)
    assert len(rows) <= 20 and all(m and y in (0, 1) for _, m, y in rows)
    assert (1, "a longer text 1", 1) in abuse.labelled(tweets, "id", "message", labels, "tweet_id", "unwanted", sample=100)


def test_bounded_sample(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id AS STRING) AS v").union(spark.range(10).selectExpr("id", "CAST(NULL AS STRING)"))
    a, b = ([r["v"] for r in bounded_sample(df.select("v"), "v", 100).collect()] for _ in range(2))
    assert a == b and len(a) == 100 and None not in a
    many = df.union(spark.range(20_000).selectExpr("7", "'7'"))  # one value holds most rows
    assert [r["v"] for r in bounded_sample(many.select("v"), "v", 100).collect()] == a
    assert len(bounded_sample(df.select("v").limit(30), "v", 100).collect()) == 30
    assert bounded_sample(df.select("v").limit(0), "v", 100).count() == 0


# --- p5 ---


@pytest.fixture(scope="module")
def redactor():
    names = [f"{f} {s}" for f in ("Anna", "Bruno", "Clara") for s in ("Weston", "Harlow-Dee", "Quint") for _ in range(3)]
    return privacy.Redactor(privacy.Lexicon(names, ["the cat is in the garden", "we go to the market", "ladder and cat says hello"] * 3))


def kinds(redactor, text):
    return {k for *_, k in redactor.find([text])[0]}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("write to anna.weston@post.example please", "email"), ("mail bruno at post dot example", "email"), ("x: clara+q [at] net[dot]test now", "email"), ("mail a.b＠post.example", "email"),
        ("call 020 7946 0123 tonight", "phone"), ("ring +49 (0)30 23125 111", "phone"), ("tel:(555) 555-0123 for news", "phone"), ("０７７００９００１２３", "phone"), ("my number is oh double seven hundred nine hundred one two three", "phone"),
        ("my SSN is 912-34-5678", "id_number"), ("passport no. X01234567 is lost", "id_number"), ("renewing DNI 01234567-Z took days", "id_number"),
        ("we live at 12 Mulberry Street", "address"), ("wir wohnen Lindenweg 4, 01234 Astadt", "address"), ("vivimos en Calle Mayor 17, 2º B", "address"), ("No 8 elm court again", "address"),
        ("thanks Anna Weston for the boat", "person_name"), ("met B. Quint there", "person_name"), ("vote Quint, Bruno for mayor", "person_name"), ("saludos a CLARA HARLOW-DEE", "person_name"), ("happy birthday Señora Weston!", "person_name"),
    ],
)
def test_details_are_found(redactor, text, kind):
    assert kind in kinds(redactor, text)


@pytest.mark.parametrize(
    "text",
    ["order 4471-1234-56 has shipped", "part no. 1234-56-7890 does not fit", "ISBN 978-0-12-345678-9 is out of print", "version 10.2.33.1 crashes", "price went from 1,245.00 to 983.50", "platform 4 Market Road side is shut", "Mr ladder is my cat", "Anna says hello", "the Weston Prize goes to a bakery", "Quint & Sons opens today", "@anna_weston hello", "see https://anna.example/12345678", "read 40 long roads of text", "", "   ", None],
)
def test_other_things_are_not(redactor, text):
    assert kinds(redactor, text) == set()


def test_placeholders_keep_the_rest(redactor):
    text = "hi, mail a​nna@post.example or call 020 7946 0123 now"
    (spans,) = redactor.find([text])
    assert redactor.redact(text, spans) == "hi, mail [EMAIL] or call [PHONE] now"


def test_held_out_quality(redactor):
    assert all(p >= 0.93 and r >= 0.9 for p, r in redactor.held_out.values()), redactor.held_out


def test_rows(spark, redactor):
    df = spark.createDataFrame([(1, "mail anna@post.example"), (2, None), (None, ""), (1, "x" * 100_000)], "id long, message string")
    got = {(r["id"], r["redacted"] and r["redacted"][:30], tuple(r["kinds"])) for r in privacy.details(df, "id", "message", redactor).collect()}
    assert got == {(1, "mail [EMAIL]", ("email",)), (2, None, ()), (None, "", ()), (1, "x" * 30, ())}


@pytest.mark.parametrize("text", ["Max ät Host Punkt de", "MAX ÄT HOST PUNKT DE", "MAX ARROBA HOST PUNTO ES", "Joe At Host Dot Com", "joe aT host dot com"])
def test_every_spelling_of_an_email_is_proposed(redactor, text):
    assert "email" in {k for k, *_ in privacy.candidates(text, redactor.lex)}


def test_word_lists_are_of_all_rows(spark, monkeypatch):
    # 60,000 authors, one of them with a surname and a first name of their own; a rare common word
    names = spark.range(60_000).selectExpr("CASE WHEN id = 777 THEN 'Zebulon Quarrington' WHEN id = 778 THEN NULL ELSE concat('Anna Weston', id % 30000) END AS v")
    messages = spark.range(60_000).selectExpr("id", "CASE WHEN id % 20000 = 5 THEN 'the turnstile' WHEN id = 9 THEN '' ELSE concat('we go to stall ', id) END AS m")
    lex = privacy.lexicon(messages, "m", names, "v")
    assert "zebulon" in lex.first and "quarrington" in lex.last and "turnstile" in lex.common
    monkeypatch.setattr(privacy, "PART", 1000)
    lex = privacy.lexicon(messages, "m", names, "v")
    assert lex.first == {"anna"} and "quarrington" not in lex.last and "turnstile" not in lex.common and "stall" in lex.common
    empty = privacy.lexicon(messages.limit(0), "m", names.limit(0), "v")
    assert empty.first == empty.last == empty.common == set()


def test_one_rule_at_every_size():
    names = ["Zebulon Quarrington"] + ["Anna Weston"] * 600
    assert "quarrington" in privacy.Lexicon(names[:400], []).last and "quarrington" in privacy.Lexicon(names, []).last


# --- p7 ---

WORDS = "amber basket candle dragon ember falcon goblet hammer island jungle kettle ladder marble needle orchid pepper quartz ribbon saddle timber urchin velvet walnut yellow zephyr anchor bridle copper donkey engine".split()


def item(r, n=24):
    return " ".join(r.choice(WORDS) + ("s" if r.random() < 0.2 else "") for _ in range(n))


@pytest.fixture(scope="module")
def bench():
    r = random.Random(8)
    return [(i, item(r)) for i in range(60)] + [(90, None), (91, ""), (92, "too short")]


def damage(text, r, rate=0.08):
    swap = {"e": "c", "n": "u", "a": "u", "h": "b", "l": "1", "o": "0", "m": "rn", "d": "rl", "s": "5"}
    return "".join(swap[c] if c in swap and r.random() < rate else c for c in text)


def test_leaks_under_damage_and_adverts(bench):
    items, r = leaks.Items(bench), random.Random(2)
    found = missed = wrong = 0
    for _ in range(150):
        i, text = r.choice(bench[:60])
        w = text.split()
        a = r.randrange(len(w) - 14)
        lines = [" ".join(w[a : a + 5]), "TO LET, A TALL HOUSE", " ".join(w[a + 5 : a + 10])[:-3] + "-", w[a + 9][-3:] + " " + " ".join(w[a + 10 : a + 14])]
        page = "Some article about the town and its council meeting.\n" + damage("\n".join(lines), r) + "\nThe end of the page came soon."
        got = leaks.search(items, page)
        found += i in got
        missed += i not in got
        wrong += len(set(got) - {i})
    assert found >= 140 and wrong == 0, (found, missed, wrong)


def test_short_and_changed_passages_are_none(bench):
    items, r = leaks.Items(bench), random.Random(3)
    for i, text in bench[:60]:
        w = text.split()
        assert leaks.search(items, "We read here: " + " ".join(w[4:10]) + " and so on for the rest of the day, said the mayor.") == []
        other = [x if k % 2 else r.choice(WORDS) for k, x in enumerate(w)]
        assert i not in leaks.search(items, " ".join(other))


def test_leak_query_on_odd_rows(spark, bench):
    items = spark.createDataFrame(bench, "item_id long, text string")
    pages = spark.createDataFrame([(1, bench[5][1], "x"), (1, bench[5][1], "x"), (2, None, "x"), (3, "", "x"), (None, bench[6][1].upper(), "x"), (4, "x " * 50_000, "x")], "doc_id long, text string, item_id string")
    got = sorted(((r["doc_id"], r["item"]) for r in leaks.leaked(pages, "doc_id", "text", items.withColumnRenamed("item_id", "item"), "item", "text").collect()), key=str)
    assert got == [(1, 5), (1, 5), (None, 6)]
    assert leaks.leaked(pages, "doc_id", "text", items.limit(0).withColumnRenamed("item_id", "item"), "item", "text").count() == 0


def test_joined_items_give_the_same(spark, bench, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in bench], "item_id long, text string")
    pages = spark.createDataFrame([(i, t) for i, t in bench[:20]], "doc_id long, text string")
    whole = {tuple(r) for r in leaks.leaked(pages, "doc_id", "text", items, "item_id", "text").collect()}
    monkeypatch.setattr(leaks, "BROADCAST_SIGNS", 0)
    assert {tuple(r) for r in leaks.leaked(pages, "doc_id", "text", items, "item_id", "text").collect()} == whole == {(i, i) for i in range(20)}


def test_slots_do_not_depend_on_the_way(spark, monkeypatch):
    r = random.Random(4)
    made = lambda: "".join(r.choice("bdgkpz") + r.choice("aeiou") for _ in range(4))
    rows = [(i, f"before each {made()} counts how many parts remain near that {made()} while others wait") for i in range(40)]
    items = spark.createDataFrame([*rows, (90, None), (91, "too short")], "item_id long, text string")
    other = [(100 + i, t.replace(t.split()[10], made())) for i, t in rows]  # one of two slots is filled otherwise
    pages = spark.createDataFrame(rows[:10] + other, "doc_id long, text string")
    found = lambda: {tuple(x) for x in leaks.leaked(pages, "doc_id", "text", items, "item_id", "text").collect()}
    whole = found()
    assert whole == {(i, i) for i in range(10)}
    monkeypatch.setattr(leaks, "BROADCAST_SIGNS", 0)
    assert found() == whole


@pytest.fixture(scope="module")
def damaged_pages(bench):
    r = random.Random(12)
    pages = []
    for d in range(80):
        w = r.choice(bench[:60])[1].split()
        a = r.randrange(len(w) - 13)
        lines = ["Some article about the town.", " ".join(w[a : a + 6]), "TO LET, A TALL HOUSE", " ".join(w[a + 6 : a + 13]), item(r, 30)]
        pages.append((f"d{d}", damage("\n".join(lines), r, 0.12)))
    return pages + pages[:3] + [(None, bench[4][1]), ("e", None), ("f", "")]


@pytest.mark.parametrize("copies", [1, 5])
@pytest.mark.parametrize("signs", [0, 2_000_000])
def test_damaged_pages_do_not_depend_on_the_way_or_on_copies(spark, bench, damaged_pages, monkeypatch, copies, signs):
    want = {(d, i) for d, t in damaged_pages for i in leaks.search(leaks.Items(bench), t)}
    monkeypatch.setattr(leaks, "BROADCAST_SIGNS", signs)
    items = spark.createDataFrame([(f"{i}-{c}", t) for i, t in bench for c in range(copies)] + [(None, bench[4][1].upper())], "item_id string, text string")
    pages = spark.createDataFrame(damaged_pages, "doc_id string, text string")
    got = [tuple(r) for r in leaks.leaked(pages, "doc_id", "text", items, "item_id", "text").collect()]
    own = [(d, i) for d, i in got if i is not None]
    assert {(d, int(i.split("-")[0])) for d, i in own} == want and (None, None) in got and len(want) > 60
    assert {i.split("-")[1] for _, i in own} == {str(c) for c in range(copies)}
    assert leaks.leaked(pages, "doc_id", "text", items.limit(0), "item_id", "text").count() == leaks.leaked(pages.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_passages_among_questions_of_one_template():
    r = random.Random(4)
    made = lambda: "".join(r.choice("bdgkpz") + r.choice("aeiou") for _ in range(4))
    asked = lambda: f"before each {made()} counts how many parts remain near that {made()} while others wait"
    rows = [(i, asked()) for i in range(40)]
    items = leaks.Items(rows)
    for i, text in rows:
        page = "\n".join([asked() for _ in range(4)] + ["Some lines about the town council stand here."] + [text] + [asked() for _ in range(4)])
        assert leaks.search(items, page) == [i]


def test_passages_of_short_words():
    rows = [(0, "it is so far up to the old inn as we go by"), (1, "ladder is at the end of it all so we go on to kettles"), (2, item(random.Random(5)))]
    items = leaks.Items(rows)
    for i, text in rows:
        assert leaks.search(items, f"The council met on Tuesday. {text}. The mayor spoke.") == [i]
    assert leaks.search(items, "it is so that we go by the old mill and up to town as it is far to the inn") == []


@pytest.mark.parametrize(("a", "b"), [("harbour", "barbour"), ("modern", "modem"), ("already", "alrearly"), ("windmill", "vvindmill"), ("yellow", "ye1low"), ("said", "ſaid")])
def test_fold(a, b):
    assert scans.fold(a) == scans.fold(b)


# --- p8 ---

ARTICLE = "The council of the town met on Tuesday and it was said that the bridge would be closed.\nA reward is offered for the return of a horse which was lost near the mill.\nThe mayor thanked the baker who had given bread to the poor of the parish.\n"
SPAM = {
    "keywords": "cheap boots boots Norton boots sale\nboots Norton cheap boots boots hats\nboots boots hats Norton boots boots\nhats boots Norton boots cheap boots\n",
    "links": "http://one-two.example/p12\nwww.three-four.test/a/b.html\nhttps://five.shop.example\nsix-seven.invalid/deals?id=5\n",
    "tags": "#redboots #bluehats #oldcoats\n#newboots #tallhats #shortcoats\n#greyboots #darkhats\n",
    "codes": "BOOT-A-1234 12.50 new hats\nHATS-B-9876 3.10 best coats\nCOAT-Z-555 99.00 top boots\nBOOT-X-777 1.00 cheap hats\n",
}
HONEST = {
    "results": "FOOTBALL RESULTS\n" + "".join(f"Norton {i}, Sutton {9 - i}.\nWeston {i}, Easton 1.\n" for i in range(8)),
    "prices": "MARKET PRICES\n" + "".join(f"wheat, red, {i}s. 4d. to {i}s. 9d.\nbarley, new, {i}s. 1d. to {i}s. 2d.\n" for i in range(6)),
    "verse": "VERSES\n" + "O silent mill, O lonely tower,\nThe miller closed the heavy door,\nAnd softly sang the river:\n" * 5,
    "links explained": "Readers who want the tables will find them at http://one.example/p1 and may print the page.\n" * 5,
    "article": ARTICLE * 3 + "See http://one.example, www.two.test\n",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam_pages(name):
    signs, lists, runs = stuffing.read_page(SPAM[name] * 3 + ARTICLE.split("\n")[0])
    assert lists > signs / 2 and runs


@pytest.mark.parametrize("name", HONEST)
def test_honest_pages(name):
    signs, lists, _ = stuffing.read_page(HONEST[name])
    assert lists < signs / 2


def test_evidence_query(spark):
    rows = [(i, SPAM[k] * 3, ["A ", "b", None][i % 3]) for i, k in enumerate([*SPAM] * 3)] + [(100 + i, HONEST[k], "a") for i, k in enumerate(HONEST)] + [(200, None, "a"), (201, "", None), (None, ARTICLE, "b"), (202, "boots " * 30_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in stuffing.page_evidence(df, "doc_id", "text", "source").collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i]["n_list"] * 2 > got[i]["n_signs"] and got[i]["n_replicated"] >= 0.5 * got[i]["n_phrases"], got[i]
        assert got[i]["n_signs"] >= got[i]["s_replicated"] > got[i]["n_signs"] / 2
    assert got[200]["n_signs"] == got[201]["n_signs"] == 0
    assert got[202]["n_list"] == got[202]["n_signs"]
    assert stuffing.page_evidence(df.limit(0), "doc_id", "text", "source").count() == 0


@pytest.mark.parametrize("name", [*SPAM, *HONEST])
def test_phrases_cover_the_lists(name):
    _, lists, runs = stuffing.read_page(SPAM.get(name, HONEST.get(name)) * 2)
    assert sum(stuffing.phrases_of(runs).values()) == pytest.approx(lists)


def test_lists_of_one_host_alone_are_not_found(spark, tmp_path):
    # both pages are lists; only the phrases of the first stand on another host too
    rows = [(1, SPAM["tags"] * 3, "a"), (2, SPAM["tags"] * 3, "b"), (3, SPAM["codes"] * 3, "a"), (4, ARTICLE, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in stuffing.p8_found(spark, str(tmp_path)).collect()} == {1, 2}


@pytest.mark.parametrize("hosts", [["one"], [None], ["one", "two"]])
def test_short_pages_and_single_hosts(spark, tmp_path, hosts):
    texts = {1: SPAM["links"] * 3, 2: ARTICLE, 3: "http://one-two.example/p12", 4: "The mill is open.", 5: "", 6: None}
    rows = [(10 * n + i, t, h) for n, h in enumerate(hosts) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in stuffing.p8_found(spark, str(tmp_path)).collect()} == {10 * n + i for n in range(len(hosts)) for i in (1, 3)}


def found_pages(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return {r["doc_id"] for r in stuffing.p8_found(spark, str(path)).collect()}


def listing(seed):
    r = random.Random(seed)
    goods = "boots hats coats wigs blinds loans phones carpets boilers tonics watches hotels".split()
    return "".join(f"{r.choice(['cheap', 'best', 'free'])} {a} {b} http://{a}{i}-{b}.example/p{i}\n" for i in range(4) for a, b in zip(goods, r.sample(goods, 12)))


def test_lists_of_other_hosts_decide_unsure_lines(spark, tmp_path):
    # half of the lines are sentences, so neighbours say nothing else of the lines between them
    between = lambda lines: "".join(f"{line}\nIt was a mill.\n" for line in lines)
    goods = ["cheap boots hats coats wigs blinds", "best loans phones carpets boilers", "free tonics watches hotels boots", "cheap carpets coats loans wigs"]
    prose = ["seven kettles remained unsold yesterday", "heavy clouds gathered over Norton", "children played near Weston bridge", "bakers closed early before Tuesday"]
    other = "kissamme istui ikkunalla katsellen lintuja\nvanha mylly seisoi hiljaa joen rannalla\nlapset juoksivat nauraen pitkin polkua\nilta saapui tummana metsän ylle\n"
    rows = [(1, listing(1), "a"), (2, listing(2), "b"), (3, between(goods), "c"), (4, between(prose), "c"), (5, other, "a"), (6, other, "b")]
    assert found_pages(spark, tmp_path, rows) == {1, 2, 3}


def test_lists_in_another_order_are_the_same_evidence(spark, tmp_path):
    # links alone, and links behind goods: no five types in a row are the same
    goods = "".join(f"boots{i} Norton >> http://{w}-mill.example/p{i}\n" for i, w in enumerate(WORDS))
    assert found_pages(spark, tmp_path, [(1, SPAM["links"] * 3, "a"), (2, goods, "b"), (3, ARTICLE * 3, "b")]) == {1, 2}


def test_words_more_usual_outside_lists_are_no_evidence(spark):
    rows = [(1, listing(1) + "Norton http://one.example/p1\n", "a"), (2, listing(2) + "Norton http://two.example/p2\n", "b"), (3, "cheap hats", "c")]
    rows += [(100 + i, "Norton\n" + "It was a mill.\n" * 4, "c") for i in range(60)]
    got = {r["doc_id"]: r for r in stuffing.page_evidence(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    assert all(got[i]["n_phrases"] == 1 and got[i]["n_replicated"] == 0 for i in range(100, 160))
    assert got[3]["n_replicated"] == got[3]["n_phrases"] == 2 and got[3]["s_replicated"] == got[3]["n_signs"]
