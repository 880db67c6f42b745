import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epistola.llm import langid, mailtext, mixing, ocr
from epistola.llm.boosting import Boosted
from epistola.llm.furniture import furniture_lines

# --- 2: mails ----------------------------------------------------------------------------------------------------------------

MAIL = """From: ana.stone@d.org
To: bo@e.org
Date: March 1, 2006
Subject: x

Dear Bo,

Please read the long report that came back this
week. The result for the site was
> 49 feet, not 20.

1) check the barrels
2) call the county

On 3 Mar 2006, Bo Hale wrote:

> Could you read the report by Friday? I have not seen
any of it so far.
>
> > an older question from somebody else

I have answered that question in the annex.

Many thanks,
Ana Stone
Senior Chemist

P.S. The annex is the second file.

Privileged and confidential. If you have received this message in error, please call the sender.

-----Original Message-----
From: someone
Old text that was sent before this one."""


def test_new_lines_of_a_mail(spark):
    df = spark.createDataFrame([(1, MAIL, "m"), (2, None, "m"), (3, "", "m"), (4, "Report\nnot a mail", "m"), (1, MAIL, "m")], "doc_id long, text string, mark string")
    got = sorted(r.line_no for r in mailtext.new_lines(df).collect())
    assert got == [6, 8, 9, 10, 12, 13, 22, 28]
    assert mailtext.new_text(df.where("doc_id <> 1 OR mark = 'm'").dropDuplicates(["doc_id"])).first().text.startswith("Dear Bo,")
    assert mailtext.new_lines(df.limit(0)).count() == 0


def test_unmarked_quotes_go_to_the_first_author(spark):
    line = "The second barrel was found behind the old pump house yesterday."
    early = f"From: bo@e.org\nTo: ana@d.org\nDate: 2001-01-01\n\n{line}\n"
    late = f"From: ana@d.org\nTo: bo@e.org\nDate: 2001-02-01\n\nI agree with all of this, thank you.\n\nOn 2001-01-01, Bo wrote:\n\n{line}\n"
    got = mailtext.new_lines(spark.createDataFrame([(1, early), (2, late)], "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 5), (2, 5)}


def test_recurrent_closing_lines(spark):
    mail = "From: ana@d.org\nTo: bo@e.org\n\nThe report number {} is ready for you now.\n\n{}\n"
    df = spark.createDataFrame([(k, mail.format(k, "Ana of the north desk" if k < 3 else "See annex four")) for k in range(4)], "doc_id long, text string")
    assert {tuple(r) for r in mailtext.new_lines(df).collect()} == {(0, 4), (1, 4), (2, 4), (3, 4), (3, 6)}


def test_disclaimers_by_recurrence(spark):
    notice = "The views in this letter bind nobody, and whoever reads it without being asked to may be sent a bill of {1} shillings."
    signed = "From: p{0}@d.org\nTo: bo@e.org\n\nThe report number {0} is ready now.\n\nMany thanks,\nPat {0}\n\n" + notice
    bare = "From: q@d.org\nTo: bo@e.org\n\nThe pumps were read on Monday.\n\nNothing else is to be said of them today.\n\n" + notice
    mails = [(k, signed.format(k, k)) for k in range(3)] + [(9, bare.format(0, 12))]
    lines = lambda rows: {tuple(r) for r in mailtext.new_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    signed_lines = {(k, 4) for k in range(3)}
    assert lines(mails) == signed_lines | {(9, 4), (9, 6)}
    assert lines(mails[:1] + mails[3:]) == {(0, 4), (9, 4), (9, 6), (9, 8)}  # one mail's closing is no recurrence


@pytest.mark.parametrize("text,day", [("Date: 2001-04-10", "2001-04-10"), ("11/03/1998 10:00", "1998-11-03"), ("Monday, February 8, 2009 2:42 PM", "2009-02-08"), ("10 Aug 2002", "2002-08-10")])
def test_days(text, day):
    y, m, d = map(int, day.split("-"))
    assert mailtext.mail_day(text) == y * 372 + m * 31 + d
    assert mailtext.mail_day("no date") is None and mailtext.mail_day(None) is None


# --- 4: scanned pages ----------------------------------------------------------------------------------------------------------


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)
    model = Boosted(rounds=80).fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.85
    assert len(model.score(x[:0])) == 0


def test_confusions_and_distance():
    assert [ocr.confusions(a, b) for a, b in (("durlng", "during"), ("retumed", "returned"), ("qiiiet", "quiet"), ("she", "the"), ("aqulfcr", "aquifer"))] == [1, 1, 1, 9, 2]
    assert ocr.distance("abcd", "acbd") == 1 and ocr.distance("", "ab") == 2


def test_furniture():
    lines = "Record of Water\nThe report was read by the members of the board and\nPg. 2\nRecord of Water\nEMA-0123456\nby the county in the second week.\n\nDrum counts:\n12\n40".split("\n")
    assert furniture_lines(lines) == {0, 2, 3, 4} or furniture_lines(lines) == {2, 3, 4}
    assert furniture_lines([]) == set() and furniture_lines(["plain text of a letter"]) == set()


def corpus(n=260):
    r = random.Random(4)
    words = "report measured quarterly contract drainage county sampling members technical monitoring described barrels shipments landowners reviewed additional summaries expensive treatment".split()
    return [(k, " ".join(r.choice(words) for _ in range(60)).capitalize() + ".") for k in range(n)]


def test_repairs(spark):
    page = "The members reviewed the quar-\nterly contract and the clrainage of the additional\nPg. 2\nEMA-0123456\nbarrels of the county. The trea tment described expensivesummaries of the landowners.\n"
    page = page.replace("The members", "the members reviewed the additional barrels of the county and the members")
    rows = [*corpus(), (900, page), (901, None), (902, "")]
    df = spark.createDataFrame([(k, t, "w") for k, t in rows], "doc_id long, text string, word string")
    got = {(r.line_no, r.fix, r.word) for r in ocr.repair_places(df).where("doc_id = 900").collect()}
    assert {(1, "join", "quarterly"), (3, "drop", ""), (4, "drop", ""), (5, "word", "treatment"), (5, "word", "expensive summaries")} <= got
    assert (2, "word", "drainage") in got
    assert ocr.repair_places(df.limit(0)).count() == 0
    assert ocr.repair_places(df.where("doc_id >= 900")).count() >= 3


def test_ranking_on_held_out_damage():
    lexicon = Counter(w for _, t in corpus() for w in t.lower().rstrip(".").split())
    model, index, rng, right, asked = ocr.train_ranker(lexicon, 0.6), ocr._Index(lexicon), random.Random(99), 0, 0
    for w in [w for w in lexicon if len(w) >= 5] * 8:
        bad = ocr.damage(w, rng)
        if bad in lexicon:
            continue
        cands = index.candidates(bad)
        asked += 1
        if cands:
            best = max(lexicon[c] for c in cands)
            s = model.score(np.array([ocr.features(bad, 1, ocr.share_of(0, 1, 0.6), c, lexicon[c], best, len(cands)) for c in cands]))
            right += cands[int(s.argmax())] == w
    assert right / asked > 0.85


def test_words_near_the_border_of_the_gram_sizes(spark):
    lines = "the members would review the notice of the joint panel until they found the study of the claim and the route of the plume"
    rows = [(k, lines.capitalize() + ".") for k in range(200)]
    bad = {"would": "woulcl", "review": "rewew", "notice": "nodce", "joint": "joirit", "panel": "pariel", "until": "uritil", "claim": "daim", "study": "stiidy"}
    page = " ".join(bad.get(w, w) for w in lines.split())
    df = spark.createDataFrame([*rows, (900, "the members said that\nPg. 2\n" + page + ".")], "doc_id long, text string")
    found = {r.word for r in ocr.repair_places(df).where("doc_id = 900 AND fix = 'word'").collect()}
    assert found <= set(bad) and len(found) >= 6


def test_words_beyond_the_lexicon_are_looked_up(spark, monkeypatch):
    page = "the members reviewed the additional barrels of the county\nPg. 2\nand the trea tment of the quar terly contracf. All is well.\n"
    rows = [*corpus(), *[(400 + k, "Rarely a hydrogeologist comes.") for k in range(8)], (900, page), (901, "the members and a hydro geologist reviewed the\nPg. 7\nbarrels of the county.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r) for r in ocr.repair_places(df).where("doc_id >= 900").collect()}
    assert {(901, 1, "word", "hydrogeologist"), (900, 3, "word", "treatment"), (900, 3, "word", "contract")} <= want
    monkeypatch.setattr(ocr, "LEXICON", 12)  # the others are in the table alone
    got = {tuple(r) for r in ocr.repair_places(df).where("doc_id >= 900").collect()}
    assert {(901, 1, "word", "hydrogeologist"), (900, 3, "word", "treatment")} <= got


def test_a_corpus_of_scans_alone(spark):
    df = spark.createDataFrame([*[(k, f"The members said\n- {k} -\n" + t) for k, t in corpus()], (900, "the members said that\nPg. 2\nthe clrainage of the county is done.")], "doc_id long, text string")
    assert (900, 3, "word", "drainage") in {tuple(r) for r in ocr.repair_places(df).collect()}


def test_planted_pages_are_found():
    rng = random.Random(8)
    words = "report measured quarterly contract drainage county sampling members technical monitoring described barrels".split()
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(11)) + ("." if k % 5 == 4 else "") for k in range(60))
    model = ocr.train_lines([text() for _ in range(60)])
    right = wrong = missed = 0
    for _ in range(30):
        lines, drop = ocr.plant_pages(text(), rng)
        able, x = ocr.line_features(lines)
        got = {k for k, p in zip(able, model.score(np.array(x, float))) if p >= 0.5}
        right, wrong, missed = right + len(got & drop), wrong + len(got - drop), missed + len(drop - got)
    assert right > 100 and wrong / right < 0.06 and missed / right < 0.06


# --- 8: mixing -----------------------------------------------------------------------------------------------------------------


def mix_tables(spark):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(["water", "county", "report", "barrel"]) for _ in range(r.randrange(5, 60))), s) for k, s in enumerate(["big"] * 120 + ["mid"] * 40 + ["tiny"] * 6)]
    rows += [(500, None, "big"), (501, "no source", None), (502, "other", "none"), (0, rows[0][1], "big")]
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, tokens int")
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 3), ("tiny", 0.15, 2), ("gone", 0.05, 4), ("null", None, None), (None, 0.05, 1)], "source string, weight double, max_repeats int")
    return d, t


def test_mix(spark):
    d, t = mix_tables(spark)
    m = mixing.Mix(d, t)
    s = {r.source: r for r in m.shares().collect()}
    c = m.copies().collect()
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    largest = max(r.tokens for r in c)
    for name in ("big", "mid"):
        assert 0 <= s[name].target_tokens - s[name].actual_tokens <= 2 * largest
    assert s["tiny"].most_copies == 2 and s["tiny"].actual_tokens == 2 * s["tiny"].available and s["tiny"].missing_tokens > 0
    assert s["gone"].actual_tokens == 0 and s["null"].target_tokens == 0
    for name in s:
        assert sum(r.tokens * r.copies for r in c if r.source == name) == s[name].actual_tokens
        assert all(r.copies <= s[name].max_repeats for r in c if r.source == name)


def test_smaller_mixes_are_nested(spark):
    d, t = mix_tables(spark)
    small, large = ({r.doc_id: r.copies for r in mixing.Mix(d, t, total).copies().collect()} for total in (600, 1500))
    assert small and all(large.get(k, 0) >= v for k, v in small.items())


def test_mix_of_nothing(spark):
    d, t = mix_tables(spark)
    assert mixing.Mix(d.limit(0), t).copies().count() == 0
    assert mixing.Mix(d, t.limit(0)).shares().count() == 0


def test_token_count_is_exact(spark):
    texts = ["", None, "Hello there, <|endoftext|> 42!", "日本" * 50]
    got = [r.n for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(mixing.token_count(F.col("x")).alias("n")).collect()]
    e = mixing._encoder(mixing.TOKENIZER)
    assert got == [0, 0, *[len(e.encode_ordinary(x)) for x in texts[2:]]]


# --- 9: languages --------------------------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0")
    model = langid.fit(train)
    p = langid.label_passages(held, model).where("stated IS NOT NULL AND confidence > 0.5")
    by = defaultdict(Counter)
    for r in p.collect():
        by[(r.doc, r.stated)][r.lang] += r.sentences
    right = sum(c.most_common(1)[0][0] == lang for (_, lang), c in by.items())
    assert right / len(by) > 0.88  # about a tenth of the labels are wrong


def test_passages(spark):
    en = ["The county has described the second report of the members.", "The members have read the report of the county again."]
    de = ["Der Bericht der Behörde wurde von den Mitgliedern gelesen.", "Die Behörde hat den Bericht der Mitglieder noch einmal gelesen."]
    rows = [(k, (en if k % 2 else de)[k % 4 // 2] * 3, "en" if k % 2 else "de") for k in range(40)]
    mixed = f"From: a@b.org\nTo: c@d.org\n\nHello Bo,\n\n{en[0]} The file \"Bericht der Behörde\" was read by the members.\n\n> {de[0]}\n\nRegards,\nBo"
    rows += [(100, mixed, "en"), (101, en[0], "de-DE"), (102, de[0], None), (103, de[1], "und"), (104, None, "en"), (105, "", "en"), (106, "No sentence", ""), (107, en[1], "EN_gb")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, stated string")
    got = {tuple(r) for r in langid.wrong_labels(df).where("doc_id >= 100").collect()}
    assert got == {(100, 3, "en"), (100, 4, "de"), (101, 1, "en"), (102, 1, "de"), (103, 1, "de")}
    doc = {r.doc_id: r for r in langid.label_documents(df).collect()}
    assert doc[100].lang == "en" and doc[100].langs == "de,en" and doc[107].confidence > 0.9
    assert langid.wrong_labels(df.limit(0)).count() == 0
    assert langid.wrong_labels(df.where("lang IS NULL")).count() == 0


@pytest.mark.parametrize(
    ("lines", "drop"),
    [
        (["Exhibit E-4", "1", *["the water of the old well was clear and cold."] * 3], {1, 2}),
        ([*["the water of the old well was clear and cold."] * 3, "p. 1"], {4}),
        ([*["the water of the old well was clear and cold."] * 3, "\fEMA-2014-6102"], {4}),
        (["the water of the old well was clear and cold.", "\fRecord of Footnotes", "and so it was with the wells of the farm."], {2}),
        (["the water of the old well was clear and cold.", "\fRecord of Landowners   EMA0635774", "and so it was with the wells of the farm."], {2}),
        (["Exhibit E-4", "the water of the old well was clear and cold."], {1}),
        (["the water of the old well was clear and cold.", "CONFIDENTIAL BUSINESS INFORMATION", "and so it was with the wells of the farm."], {2}),
        (["From: a@b.org", "", "all is well here.", "", "", "-----Original Message-----", "so it is.", "", "-----Original Message-----", "and it was."], set()),
    ],
)
def test_furniture_without_other_traces_of_a_page(lines, drop):
    assert "\f" in "".join(lines) or not ocr.paged("\n".join(lines))  # a form feed is a trace by itself
    none = Boosted(base=-9.0, edges=[np.zeros(0)] * 6)
    run = ocr._repairer({}, False, set(), None, none, pa.int64())
    rows = next(run([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["\n".join(lines)])], names=["doc", "text"])])).to_pylist()
    assert {r["line_no"] for r in rows if r["fix"] == "drop"} == drop


def test_a_date_behind_a_long_list_of_recipients(spark):
    line = "The second barrel was found behind the old pump house yesterday."
    many = ", ".join(f"someone{k}@e.org" for k in range(200))
    early = f"From: bo@e.org\nTo: {many}\nDate: 2001-01-01\n\n{line}\n"
    late = f"From: ana@d.org\nTo: bo@e.org\nDate: 2001-02-01\n\nI agree with all of this, thank you.\n\nOn 2001-01-01, Bo wrote:\n\n{line}\n"
    got = mailtext.new_lines(spark.createDataFrame([(1, early), (2, late)], "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 5), (2, 5)}
