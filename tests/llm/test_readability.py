import pytest

from cohortlab.llm import readability as r

EASY = "The scan takes two minutes. You can bring a cup. It does not hurt. We look at your back on a screen. Ask your mum to come with you. "
MIDDLE = "The hospital keeps a record of a blood test so that later pictures can be compared. Although a simple cyst can be uncomfortable, many patients recover well after three months. "
HARD = "Multivariable regression demonstrated that preoperative serum biomarker concentrations necessitated multidisciplinary re-evaluation after adjustment for institutional clustering and histopathological stage. "
LONG = "That how each of the sites chose to count them leaves it open is a point which, for all that has been said on the one side and on the other, no one who has had to work from these files, and not from the women, is in a place to settle. "


WORDS = {
    1: "the take b xyz looked eye eyes cream clear choice played league fruit makes clothes aches red be pier priest real quote you yes breathe",
    2: "minutes table wanted changes question science being poem chaos diet quiet naked rhythm patient movement people surgeon create beyond royal technique fluid language partial million lion union region someone prism simple boxes soldier conscience client ancient cruel naive frequent useful",
    3: "period recipe simile ovary ultrasound appointment element carefully creation nuclear museum nucleus coincide myoma suitable actual opinion religion medium video theory diseases easier idea area nausea physicians usual measurement settlement",
    4: "operation ovarian mechanism society variety anxiety experience reality appreciate evaluate coagulate",
    5: "hyperplasia laparoscopy hypoechoic ambiguity continuity",
    6: "radiotherapy oophorectomy",
}


def test_syllables():
    wrong = {w: r.syllables(w) for n, words in WORDS.items() for w in words.split() if r.syllables(w) != n}
    assert wrong == {}
    assert r.syllables("ovarian" * 20_000) > 60_000


def test_cleaning():
    assert r.cleaned("See No. 4, e.g. p. 12. Vol. approx. 18.4 ml.").count(".") == 3
    assert r.cleaned("<b>a</b>&nbsp;b &amp; c\n- d -- e / f - g").split() == ["a", "b", "and", "c", "d", "e", "f", "-", "g"]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def references(spark):
    return spark.createDataFrame([(b, t * k) for k in (2, 3, 4) for b, t in ((1, EASY), (2, MIDDLE), (3, HARD), (3, LONG))], "level_band long, text string")


def test_levels(spark):
    german = "Die Kontrolle erfolgt nach der Menopause und der Befund ist nicht klar. Bitte kommen Sie im Verlauf wieder. "
    texts = [EASY * 3, MIDDLE * 3, HARD * 4, LONG * 3, EASY.upper() * 3, (EASY * 3).replace(". ", "\n").lower(), "- " + (MIDDLE * 3).replace(". ", "\n- "), german * 6, "난소 낭종 소견은 외래에서 확인되지 않았다. " * 20, EASY, None, "", " 12 ?! "]
    rows = {x.doc_id: x for x in r.with_level(table(spark, texts), references(spark)).collect()}
    assert [rows[i].level_band for i in range(7)] == [1, 2, 3, 3, 1, 1, 2]
    assert all(rows[i].is_english for i in range(7)) and not any(rows[i].is_english for i in (7, 8, 10, 11, 12))
    assert [rows[i].grade for i in (10, 11, 12)] == [None] * 3 and [rows[i].level_band for i in (10, 11, 12)] == [None] * 3
    found = {x.doc_id for x in r.english_levels(table(spark, texts), references(spark)).collect()}
    assert found == set(range(7))


def test_measures_against_plain_counting(spark):
    row = r.measures(table(spark, ["One two three. Four five?\nSix"]), r.fit_profile(references(spark))).first()
    assert (row.n_words, row.n_sentences, row.n_letters) == (6, 3, 22)


def test_the_profile_counts_every_passage(spark):
    many = spark.range(6000).selectExpr("id % 3 as level_band", "concat('the ', if(id % 2 = 0, 'ab', 'cyst'), if(id % 3 = 0, ' low', '')) as text").unionByName(spark.sql("select 1L level_band, cast(null as string) text"))
    profile = r.fit_profile(many)
    assert profile.total == 6000 * 3 + 3000 * 2 + 3000 * 4 + 2000 * 3
    assert {t: profile.triples[t] for t in (" th", "he ", " ab", "ab ", "yst", "ow ")} == {" th": 6000, "he ": 6000, " ab": 3000, "ab ": 3000, "yst": 3000, "ow ": 2000}
    assert profile.frequent == {"the", "ab", "cyst"}
    assert r.fit_profile(many.limit(0)).total == 0


def test_banners_do_not_count(spark):
    banner = "This communication is intended exclusively for the designated recipient and may contain confidential information."
    docs = table(spark, [f"{banner}\n{EASY}no {i}. {'x' * i}" for i in range(30)] + [EASY] * 3)
    assert r.banners(docs).count() == 1
    rows = r.with_level(docs, references(spark)).where("doc_id < 30").collect()
    assert all(x.level_band == 1 for x in rows)


def test_copies_make_no_banner(spark):
    lines = [EASY * 3, MIDDLE, EASY * 2 + "It is done."]
    texts = ["\n".join(lines)] * 40 + ["Page 1 of 2\n" + "\n".join(lines)] * 5 + [f"Page 1 of 2\n{EASY}no {'x' * i}." for i in range(1, 8)] + [f"{EASY}at {'y' * i}." for i in range(1, 70)]
    docs = table(spark, texts)
    assert r.banners(docs).count() == 1  # "Page 1 of 2", on eight distinct texts
    found = {x.doc_id for x in r.english_levels(docs, references(spark)).collect()}
    assert found >= set(range(45))
    rows = {x.doc_id: x.n_words for x in r.with_level(docs, references(spark)).where("doc_id < 45").collect()}
    whole = sum(len(line.split()) for line in lines)
    assert set(rows.values()) == {float(whole)}


def test_long_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, EASY * 5000, "k"), (1, EASY * 5000, "k"), (2, "a" * 500_000, "k")], "doc_id long, text string, grade string")
    rows = r.with_level(df, references(spark)).collect()
    assert len(rows) == 3 and [x.level_band for x in rows if x.doc_id == 1] == [1, 1]
    assert r.with_level(df.limit(0), references(spark)).count() == 0
    assert r.english_levels(df.limit(0), references(spark)).count() == 0


def test_long_tags_and_comparisons():
    assert r.cleaned("a <div style='" + "x" * 5000 + "'> b").split() == ["a", "b"]
    assert r.cleaned("ca < 35 and he > 70").split() == ["ca", "<", "35", "and", "he", ">", "70"]


FOREIGN = {
    "French": "Le patient presente une douleur abdominale depuis trois semaines et le traitement a ete change sans amelioration notable. La consultation de radiologie montre une formation kystique de la region pelvienne avec une organisation reguliere et une indication de surveillance. Une operation est une solution si la formation persiste apres le traitement et la situation generale du patient permet une intervention.",
    "Dutch": "De patient heeft sinds drie weken pijn in de buik en de behandeling is zonder verbetering veranderd. Het onderzoek laat een cyste zien in het bekken en de arts wil haar over zes weken weer zien.",
    "Romanian": "Pacienta are dureri abdominale de trei saptamani si tratamentul nu a produs nicio ameliorare. Examinarea arata o formatiune in regiunea pelvina si medicul recomanda un nou control peste sase saptamani.",
    "Swedish": "Patienten har haft ont i magen i tre veckor och behandlingen har inte gett nagon forbattring. Undersokningen visar en cysta i backenet och lakaren vill se henne igen om sex veckor.",
    "Italian": "La paziente ha dolore addominale da tre settimane e il trattamento non ha prodotto alcun miglioramento. La operazione serve solo se la formazione cresce.",
}
ENGLISH = (
    "The committee shall meet quarterly in order to review budgets, appoint new officers, and approve minutes of the previous session. My grandmother baked bread every Sunday while the children chased chickens around the yard until supper.",
    "Kernel scheduling latency regressions were bisected to a commit touching the lock of the queue; reverting it restores the throughput that was lost to contention.",
)


def test_language_by_profile(spark, small):
    profile = r.fit_profile(spark.read.parquet(f"{small}/level_refs.parquet"))
    assert {"the", "and", "to"} <= profile.frequent
    for language, text in FOREIGN.items():
        assert not r.counts(text * 2, frozenset(), {}, profile)[5], language
    for text in (*ENGLISH, EASY * 3, MIDDLE, HARD, LONG):
        assert r.counts(text, frozenset(), {}, profile)[5]
    assert not r.counts(EASY, frozenset(), {}, r.Profile({}, frozenset()))[5]


def test_banners_stand_at_edges_whatever_the_size(spark):
    line, banner = "Most cysts go away without help.", "Printed for the ward."
    inside = [f"{EASY}no {'x' * i}.\n{line}\nAt the end {'y' * i}." for i in range(6)]
    edges = [f"{line}\n{EASY}as {'z' * i}." for i in range(6)] + [f"{EASY}at {'w' * i}.\n{banner}" for i in range(6)]
    for more in (0, 3000):
        docs = table(spark, inside + edges + [f"{MIDDLE} {'v' * (i % 50)} {i}" for i in range(more)])
        assert [x.digest for x in r.banners(docs).collect()] == [r._digest(banner)]


def test_same_level_alone_and_in_a_large_table(spark, monkeypatch):
    banner = "This communication is intended exclusively for the designated recipient and may contain confidential information."
    docs = table(spark, [f"{banner}\n{EASY}no {i}. {'x' * i}" for i in range(30)] + [EASY * 3, MIDDLE * 2, HARD * 3])
    digests = r.banners(docs)
    whole = {x.doc_id: (x.grade, x.level_band) for x in r.with_level(docs, references(spark)).collect()}
    for i in (0, 29, 30, 32):
        row = r.with_level(docs.where(f"doc_id = {i}"), references(spark), banner_digests=digests).first()
        assert (row.grade, row.level_band) == whole[i]
    monkeypatch.setattr(r, "BROADCAST_ROWS", 0)  # digests are joined, not broadcast
    assert {x.doc_id: (x.grade, x.level_band) for x in r.with_level(docs, references(spark)).collect()} == whole


def test_no_references(spark):
    row = r.with_level(table(spark, [EASY]), references(spark).limit(0)).first()
    assert row.level_band is None and not row.is_english and row.grade is not None
