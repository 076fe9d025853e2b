"""Scan repair, personal information, look-alikes, leakage and subjects on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.llm import leakage, lookalikes, pii, scans, subjects

DOC = "doc_id long, text string, extra string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC)


def lines(text):
    return scans.record_lines([("", None, text)])


KNOWN = {w: 100 for w in "the optical signal was measured before frost damaged frost-damaged barley crop recovered and noted in pencil title".split()}
LEX = scans.Lexicon(KNOWN, 1)


def test_weighted_distance_prefers_confusions():
    assert scans.weighted_distance("modern", "modem") < scans.LIMIT
    assert scans.weighted_distance("partial", "partia1") == pytest.approx(0.3)
    assert scans.weighted_distance("cat", "cut") >= 1


def test_page_furniture_and_broken_words():
    text = "Annex barley crop\nthe optical sig-\nPage 1 of 2\nAnnex barley crop\nnal was frost-\ndamaged before\nPage 2 of 2"
    found = {(i, k) for i, k, *_ in scans.record_findings(lines(text), LEX) if k != "word"}
    assert found == {(0, "running_header"), (3, "running_header"), (2, "page_number"), (6, "page_number"), (1, "broken_word")}


def test_damaged_header_of_a_long_record():
    r = random.Random(3)
    parts = []
    for page in range(90):
        if page in (0, 1, 85):
            parts.append((f"{page}.0", page, "Annex on barley crops" if page < 85 else "Annex on barlxy crops"))
        parts.append((f"{page}.1", page, "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(30)).capitalize()))
    lines = scans.record_lines(parts)
    assert [lines[i][0] for i in sorted(scans.furniture(lines))] == ["0.0", "1.0", "85.0"]


def test_numbers_of_a_table_are_no_page_numbers():
    text = "barley crop\n12\n770.88\ntitle\n13\n310.56"
    assert not [x for x in scans.record_findings(lines(text), LEX) if x[1] == "page_number"]


def test_misread_numbers_but_not_codes():
    out = [x[2] for x in scans.record_findings(lines("in 2O22 and B16407/3 and H2O"), scans.Lexicon(KNOWN | {"h2o": 50}, 1)) if x[1] == "misread"]
    assert out == ["2O22"]


def test_set_text_joins_and_repairs():
    text = "the optical sig-\nnal was rneasured\n\nnoted in pencil"
    assert scans.set_text(lines(text), {}, {0}, {"rneasured": "measured"}) == "the optical signal was measured\n\nnoted in pencil"


def test_what_follows_a_joined_word_stays_with_it():
    assert scans.set_text(lines("the optical sig-\nnal, it was mea-\nsured.\nnoted"), {}, {0, 1}, {}) == "the optical signal, it was measured. noted"


def test_defects_end_to_end(spark):
    part = "array<struct<node:string,page:int,text:string>>"
    rows = [("documents", str(i), [("", None, "the laboratory measured the signal again")]) for i in range(30)]
    rows += [("documents", "x", [("", None, "the laboratory rneasured it\nagain")]), ("documents", "y", [("", None, "")])]
    df = spark.createDataFrame(rows, f"tbl string, rec_id string, parts {part}")
    got = {tuple(r) for r in scans.defects(df).collect()}
    assert got == {("documents", "x", "", 0, "misread")}
    assert scans.defects(df.limit(0)).count() == 0


PARTS = "tbl string, rec_id string, parts array<struct<node:string,page:int,text:string>>"


def records(spark, texts):
    return spark.createDataFrame([("documents", str(i), [("", None, t)]) for i, t in enumerate(texts)], PARTS)


@pytest.mark.parametrize("bound", [60_000, 1])
def test_word_before_decides_at_any_number_of_candidates(spark, monkeypatch, bound):
    monkeypatch.setattr(scans, "CONTEXT_PAIRS", bound)
    found = spark.createDataFrame([("documents", "9", "", 0, "xoal", "old", 7)], "tbl string, rec_id string, node string, line_no int, word string, prev string, same_text long")
    wrong = spark.createDataFrame([("xoal", "coal", 0.3, 20, 1), ("xoal", "goal", 0.3, 40, 1)], "word string, right string, cost double, n long, own long")
    got = scans.chosen_repairs(records(spark, ["old coal", "the goal", "the goal"]), found, wrong)
    assert [r["right"] for r in got.collect()] == ["coal"]


def test_a_word_with_a_context_of_its_own_is_kept(spark):
    texts = [f"they paid the tax in month {i}" for i in range(400)] + [f"sent by fax on day {i}" for i in range(20)] + [f"he paid thc tax of year {i}" for i in range(14)]
    got = {tuple(r)[1:] for r in scans.judged(records(spark, texts)).repairs.select("tbl", "word", "right").distinct().collect()}
    assert got == {("thc", "the")}


@pytest.mark.parametrize("bound", [50, 3])
def test_the_bound_of_the_frequent_words_changes_nothing(spark, monkeypatch, bound):
    r = random.Random(9)
    words = [a + b for a in "bar dol ken lim mor nas".split() for b in "gad vost quil nard temp".split()]
    texts = []
    for i in range(160):
        w = [r.choice(words) for _ in range(40)] + ["2O22", f"under{i % 3}stand"]
        w[7] = "well-worn" if i % 2 else w[7]
        if i % 4 == 0:
            w[9] = w[9].replace("m", "rn")
        lines_ = [" ".join(w[k : k + 8]) for k in range(0, len(w), 8)]
        if i % 3 == 0:
            lines_[1] += " bar-" if i % 2 else " well-"
            lines_[2] = ("gad " if i % 2 else "worn ") + lines_[2]
        texts.append("\n".join(lines_) + f"\nPage {i % 9}")
    df = records(spark, texts)
    whole = {tuple(x) for x in scans.defects(df).collect()}
    mended = {tuple(x) for x in scans.repaired(df).collect()}
    monkeypatch.setattr(scans, "COMMON_WORDS", bound)
    assert {tuple(x) for x in scans.defects(df).collect()} == whole
    assert {tuple(x) for x in scans.repaired(df).collect()} == mended
    assert {x[4] for x in whole} == {"broken_word", "misread", "page_number"}


def test_page_numbers_are_read_in_any_case():
    for text in ("page 1o", "Seite 2b", "- 1o -"):
        assert [x[1] for x in scans.record_findings(lines(f"barley crop\n{text}\ncrop recovered"), LEX) if x[1] == "page_number"], text


def test_every_header_of_a_long_record():
    r = random.Random(4)
    parts = []
    for page in range(6):
        parts.append((f"{page}.0", page, "Annual report on barley" if page != 3 else "Annual rep0rt on barley"))
        parts += [(f"{page}.{k}", page, "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(40)).capitalize()) for k in range(1, 31)]
    long = scans.record_lines(parts)
    assert [long[i][0] for i in sorted(scans.furniture(long))] == [f"{p}.0" for p in range(6)]


@pytest.mark.parametrize("right,read", [("clause", "c1ause"), ("trial", "trlal"), ("modern", "modem"), ("held", "hcld"), ("disputed", "clisputecl"), ("occurred", "occiirred")])
def test_misread_words_meet_their_right_ones(right, read):
    assert set(scans.delete_keys(right)) & set(scans.delete_keys(read))
    assert scans.weighted_distance(right, read) <= scans.LIMIT


def test_copies_of_a_scan_do_not_hide_its_misread_words(spark):
    part = "array<struct<node:string,page:int,text:string>>"
    rows = [("documents", str(i), [("", None, f"the laboratory measured signal {i} again")]) for i in range(30)]
    rows += [("documents", f"x{i}", [("", None, "the laboratory rneasured it\nagain")]) for i in range(15)]
    df = spark.createDataFrame(rows, f"tbl string, rec_id string, parts {part}")
    got = {tuple(r) for r in scans.defects(df).collect()}
    assert got == {("documents", f"x{i}", "", 0, "misread") for i in range(15)}


def test_tagger_finds_kinds_and_leaves_decoys(spark):
    text = (
        "Contact person: Helen Aldringsby. Call +44 20 7946 0147 during office hours. Tax id 00-1525308 was printed twice. "
        "Send corrections to peter.ulmi@posthouse.example. Please mail the copy to 301 Dextercroft Avenue, Dellorcliff 81888 by courier. "
        "Serial A382336448 and lot REF382336448 are unrelated. Build 10.4.0.94 produced the page."
    )
    got = {(r.kind, r.pii_value) for r in pii.personal_spans(docs(spark, [text, None, "", "plain words only"]), ["doc_id"], "text").collect()}
    assert got == {("name", "Helen Aldringsby"), ("phone", "+44 20 7946 0147"), ("id_number", "00-1525308"), ("email", "peter.ulmi@posthouse.example"), ("address", "301 Dextercroft Avenue, Dellorcliff 81888")}
    masked = pii.masked(docs(spark, [text]), "text").first()
    assert "[NAME]" in masked.text and "Aldringsby" not in masked.text and masked.extra == "x" and "REF382336448" in masked.text


@pytest.mark.parametrize("text", ["its number is AB123456C here", "to weg 5, D-12345 ort", "see tel.0171 2345678 now", "call 555-0134 now", "mail x [at] y dot org"])
def test_each_shape_has_a_place(text):
    assert pii.regions(text)


def test_viterbi_equals_brute_force():
    t = pii.Tagger.load()
    k = len(pii.TAGS)
    es = [t.emissions(pii.encoded(text)[:, None])[:, 0] for text in ("Att", "Mr", "x1@")]
    for e, got in zip(es, t.decode(es)):
        seqs = [(a,) for a in range(k)]
        for _ in range(len(e) - 1):
            seqs = [(*s, b) for s in seqs for b in range(k)]
        score = lambda s: t.w["start"][s[0]] + e[0, s[0]] + sum(t.w["trans"][a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(s, s[1:])))
        assert tuple(got) == max(seqs, key=score)


def test_the_network_finds_unseen_values_without_the_check():
    """Names, hosts and towns here come from neither the corpus nor the generator."""
    text = (
        "Contact person: Ludmila Okonkwo-Brandt will answer. Send corrections to l.okonkwo@quarzhof.example by Friday. "
        "Tel: +44 161 496 0735 during the day. SSN: 417-29-8863 was printed twice. Please mail the copy to 18 Marchmont Road, Appledore 40312 by courier."
    )
    got = {(k, text[a:b]) for k, a, b in pii.spans_of([text], pii.Tagger.load(), check=False)[0]}
    assert {("email", "l.okonkwo@quarzhof.example"), ("phone", "+44 161 496 0735"), ("id_number", "417-29-8863"), ("address", "18 Marchmont Road, Appledore 40312")} <= got
    assert any(k == "name" and "Okonkwo" in v for k, v in got)


def test_windows_are_reconciled_over_long_stretches():
    """A stretch of many windows is decoded as one: a span over a window's edge comes out whole."""
    text = " ".join(f"Contact person: Helen Aldringsby{i}." if i % 9 else "Contact person: Helen Aldringsby." for i in range(1, 40))
    found = pii.spans_of([text], pii.Tagger.load(), check=False)[0]
    assert all(text[a - 1] == " " for _, a, _ in found) and sum(text[a:b] == "Helen Aldringsby" for _, a, b in found) >= 3


def test_masked_reviews(spark):
    payload = '{"note": "Contact person: Helen Aldringsby. Tel: +44 20 7946 0147", "items": [{"n": 1, "mail": "peter.ulmi@posthouse.example"}], "empty": null}'
    df = spark.createDataFrame([("a", payload), ("b", None), ("c", "not json Contact person: Helen Aldringsby."), ("d", "{}")], "review_id string, payload string")
    got = {r.review_id: r.payload for r in pii.masked_json(df, "payload").collect()}
    assert got["b"] is None and got["d"] == "{}"
    assert got["a"] == '{"note": "Contact person: [NAME]. Tel: [PHONE]", "items": [{"n": 1, "mail": "[EMAIL]"}], "empty": null}'
    assert "Aldringsby" not in got["c"]


def test_lookalikes(spark):
    texts = ["The сору of αβ is ａｂ", "Café no break zero​width", "Завод Красный Клен", "Послe проверки добавлены", "plain", None, "", "СЕВЕРКА ЛАДА in English text here"]
    df = docs(spark, texts)
    out = {r.doc_id: r.text for r in lookalikes.normalized(df, "doc_id", "text").collect()}
    assert out[0] == "The copy of αβ is ab"
    assert out[1] == "Café no break zerowidth"
    assert out[2] == texts[2] and out[4] == "plain" and out[5] is None and out[6] == ""
    assert out[3] == "После проверки добавлены"
    assert out[7] == texts[7]
    assert {r.doc_id for r in lookalikes.changed_rows(df, ["doc_id"], "text").collect()} == {0, 1, 3}


def test_whole_latin_words_in_cyrillic_text(spark):
    df = docs(spark, ["Отчет о проверке c завода добавлен", "Завод ABC Ltd работает"])
    out = {r.doc_id: r.text for r in lookalikes.normalized(df, "doc_id", "text").collect()}
    assert out[0] == "Отчет о проверке с завода добавлен" and out[1] == "Завод ABC Ltd работает"


def test_leakage_against_plain_containment(spark):
    r = random.Random(5)
    words = [f"{a}{b}" for a in "ba do ke li mu no pa ri so tu".split() for b in "lan mer tig voss quil nard".split()]
    items = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(8)]
    texts = []
    truth = set()
    for d in range(60):
        own = [r.choice(words) for _ in range(120)]
        if d % 3 == 0:
            i = r.randrange(8)
            n = r.choice([26, 40, 60, 15])
            at = r.randrange(0, 61 - n)
            piece = items[i][1].split()[at : at + n]
            if n > 30:
                piece[n // 2] = "changed"
            own[50:50] = [w.upper() + ("-\n" if k % 7 == 0 else "") for k, w in enumerate(piece)]
            if n >= 26:
                truth.add((d, i))
        texts.append(" ".join(own))
    got = {(a, b) for a, b in leakage.leaked_items(docs(spark, texts + [None, ""]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == truth
    assert leakage.leaked_items(docs(spark, texts).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def plain_distance(a: bytes, b: bytes) -> int:
    """Least edits from ``a`` to any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_alignment_equals_the_plain_table():
    assert leakage.within_edits(b"kitten", b"xxsittenxx", 1)
    assert not leakage.within_edits(b"kitten", b"xxsizzlexx", 2)
    r = random.Random(8)
    for _ in range(200):
        a, b = (bytes(r.choice(b"abc") for _ in range(r.randint(0, 14))) for _ in range(2))
        for k in range(4):
            assert leakage.within_edits(a, b, k) == (plain_distance(a, b) <= k), (a, b, k)


def test_word_offsets_follow_the_fold():
    words = "corn rind vivid accll is river no 17 vv".split()
    off, alone = leakage.word_offsets(words), [len(leakage.fold(" ".join(words[:i]))) for i in range(len(words) + 1)]
    assert off[-1] == alone[-1] and off[0] == 0
    assert all(0 <= b - a <= 1 for a, b in zip(off, alone))  # one character less where a sequence runs across into the next word


@pytest.mark.parametrize("rate", [0.01, 0.03, 0.05, 0.06, 0.08, 0.1, 0.15])
def test_scattered_edits_against_plain_alignment(rate):
    r = random.Random(int(rate * 100))
    letters = "adgjkmnpuvxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(60))) for i in range(6)]
    index = leakage.ItemIndex(items)
    texts, pieces = [], []
    for d in range(60):
        i = r.randrange(6)
        words = items[i][1].split()
        at = r.randrange(0, 61 - 30)
        piece = list(" ".join(words[at : at + 30]))
        places = [k for k, c in enumerate(piece) if c != " "]
        for k in r.sample(places, int(rate * len(places))):
            piece[k] = r.choice(["", r.choice(letters), piece[k] + r.choice(letters)])
        texts.append(" ".join(word() for _ in range(20)) + " " + "".join(piece) + " " + " ".join(word() for _ in range(20)))
        pieces.append(i)
    folded = [leakage.fold(t) for t in texts]
    truth = set()
    for d, i in enumerate(pieces):
        start, end, edits, _ = index.passages[i]
        if any(plain_distance(index.streams[i][a:b], folded[d]) <= k for a, b, k in zip(start, end, edits)):
            truth.add((d, i))
    assert set(index.search(folded)) == truth
    assert len(truth) == 60 if rate <= 0.06 else True


def test_one_wrong_character_in_every_third_word(spark):
    r = random.Random(11)
    words = ["".join(r.choice("adgjkmnpuvxyz") for _ in range(r.randint(4, 7))) for _ in range(60)]
    hurt = [w[:2] + "w" + w[3:] if k % 3 == 0 else w for k, w in enumerate(words)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "ab"), (3, None), (4, "")], "item_id long, text string")
    got = {tuple(x) for x in leakage.leaked_items(docs(spark, [" ".join(hurt), "nothing of it", "x AB y", None]), items).collect()}
    assert got == {(0, 1), (2, 2)}


def test_items_beyond_the_bound_are_searched_in_parts(spark, monkeypatch):
    r = random.Random(12)
    items = [(i, " ".join("".join(r.choice("adgjkmnpuvxyz") for _ in range(5)) for _ in range(40))) for i in range(20)]
    df = docs(spark, [f"before {t} after" for _, t in items])
    monkeypatch.setattr(leakage, "ITEM_BOUND", 1000)
    got = {tuple(x) for x in leakage.leaked_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(20)}


@pytest.mark.parametrize("cells", [leakage.CELLS, 10])
def test_counting_and_sorting_bands_agree(monkeypatch, cells):
    monkeypatch.setattr(leakage, "CELLS", cells)
    r = random.Random(13)
    items = [(i, " ".join("".join(r.choice("adgjkm") for _ in range(4)) for _ in range(40))) for i in range(5)]
    texts = [leakage.fold("zz " + " ".join(items[i % 5][1].split()[i % 9 : 30 + i % 9])) for i in range(30)] + [b"", b"ab"]
    assert leakage.ItemIndex(items).search(texts) == [(i, i % 5) for i in range(30)]


def test_subjects(spark):
    texts = [
        "The arbitration clause binds the plaintiff, and the tribunal revoked the settlement deed and the injunction as filed.\n\nThe goalkeeper and the midfielder trained at the stadium before the cup tie and the penalty kick.",
        "The insulin pump helped the ward nurse while the patient cohort saw the informed consent and the blood pressure readings.",
        "", None, "nothing to see here at all in this short text about nothing",
    ]
    got = {tuple(r) for r in subjects.document_subjects(docs(spark, texts)).collect()}
    assert got == {(0, "law"), (0, "sport"), (1, "medicine")}


def test_calibration_takes_every_label(spark):
    """The first 20,000 labels by hash speak for a low share, the rest for a high one; all together for the high one."""
    order = Window.orderBy(F.xxhash64("doc_id", "subject"), "doc_id")
    labels = spark.range(65_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("subject"))
    ranked = labels.select("doc_id", (F.row_number().over(order) <= 20_000).alias("early"))
    paragraph = lambda s, share: F.struct(F.lit(s).alias("subject"), F.lit(share).alias("share"))
    rows = F.when(F.col("early"), F.array(paragraph("a", 0.45))).otherwise(F.array(paragraph("b", 0.45), paragraph("a", 0.9)))
    scores = ranked.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*", F.lit(50.0).alias("density"), F.lit(3).alias("n"), F.lit(40).alias("words"))
    assert subjects.calibrate(scores, labels.unionByName(labels.limit(5))) == (0.8, 30.0)
    assert subjects.calibrate(scores.limit(0), labels.limit(0)) == (0.8, 30.0)


def test_the_network_reads_every_character():
    """Nothing passes a text over: every character is read in the context of its text, whatever stands around it."""

    class Marks(pii.Tagger):
        def emissions(self, x):
            e = super().emissions(x)
            e[x == pii._INDEX["q"]] += np.where(np.arange(len(pii.TAGS)) == pii.TAGS.index("I-name"), 1000, 0)
            return e

    with np.load(pii.MODEL) as f:
        tagger = Marks({k: f[k] for k in f.files})
    plain = "all of this is in small letters " * 30
    texts = [plain + "qqqqqqq " + plain, "", "qqq", plain * 20]
    assert pii.regions(texts[0]) == []
    found = pii.spans_of(texts, tagger, check=False)
    assert ("name", len(plain), len(plain) + 7) in found[0] and not found[1]


def test_dates_and_counts_are_no_ids_and_addresses():
    assert not pii.plausible("id_number", "2019-04-27") and pii.plausible("id_number", "417-29-8863")
    assert not pii.plausible("address", "792 metres") and not pii.plausible("address", "September 2021")
    assert pii.plausible("address", "18 Marchmont Road, Appledore 40312") and pii.plausible("address", "PO Box 12, Ulmen") and pii.plausible("address", "7 Oak Lane, Ulmen HF1 2QV")


def test_tags_of_whole_texts_are_those_of_one_viterbi_pass():
    """Places that can only hold the first tag are left out of Viterbi, with the same tags; windows share their places fully."""
    t, r = pii.Tagger.load(), np.random.default_rng(5)
    for bias in (0, 4, 8, 16):
        es = [(r.normal(size=(int(n), len(pii.TAGS))) * 4 + np.eye(len(pii.TAGS))[0] * bias).astype(np.float32) for n in (1, 2, 40, 300, 1)]
        assert all((a == b).all() for a, b in zip(t.decode(es), t._viterbi(es)))
    for n in (1, 127, 128, 129, 224, 225, 1000):
        ws = pii.windows([[(0, n)]])
        total, part = np.zeros(n), pii.shares(ws, [(0, 0, n)] * len(ws), min(n, pii.WINDOW))
        for col, (_, _, a, b) in enumerate(ws):
            total[a:b] += part[: b - a, col, 0]
        assert np.allclose(total, 1)


def test_a_character_costs_three_gates_without_exponentials():
    """Per character and direction one product of at most 3 x 24 gates and the tags with 24 units, 8 letters and a bias; scores do not hang on the other columns."""
    t = pii.Tagger.load()
    assert t.gates["f"].shape[0] <= 3 * 24 + len(pii.TAGS) and t.gates["f"].shape[1] <= 24 + 8 + 1
    texts = ["Contact person: Helen Aldringsby.", "Tel", "x1@y.example"]
    x = np.zeros((40, 3), np.int16)
    for col, text in enumerate(texts):
        x[: len(text), col] = pii.encoded(text)
    for col, text in enumerate(texts):
        assert np.allclose(t.emissions(x)[: len(text), col], t.emissions(pii.encoded(text)[:, None])[:, 0], atol=1e-4)
