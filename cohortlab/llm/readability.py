"""Reading level of each document from classic readability formulas.

The text is cleaned of markup, list marks and abbreviations' full stops; ends of
sentences are . ! ? and line ends; syllables come from hyphenation patterns, once
per distinct word. Five grade estimates (Flesch-Kincaid, Gunning fog, SMOG,
Coleman-Liau, ARI) are combined by their median. The band limits lie half-way
between the grades of graded reference passages.

A text is English by a profile of the reference passages: the likelihood of its
words' letter triples, and, where that leaves it open, the share of words that
are frequent in every band.

A line that heads or ends at least ``BANNER_TEXTS`` distinct texts, and hardly ever
stands between other lines, is a banner and does not count. The rule looks at
the line alone and not at the size of the table; to grade a part of a corpus as
within the whole, give ``with_level`` the digests found in the whole.

Counting words needs a loop over each text, which Arrow batches do with less
CPU than the same counts by regular expressions in the JVM; all formulas,
statistics and joins are built-in expressions.

Defined results: null, empty and wordless texts have no grade and no band, and
count as not English; whole texts are measured however long (every pattern runs
in linear time); repeated rows each get their level; extra columns are kept,
those added replace columns of the same names; without references there is no
profile and no band, and no text counts as English.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.syllables import syllables
from cohortlab.operators.joins import BROADCAST_ROWS, checked_join
from cohortlab.session import materialize

MIN_WORDS = 60
#: A banner heads or ends so many distinct texts at least, and this share of the distinct texts it occurs in.
BANNER_TEXTS, BANNER_EDGE = 5, 0.9
#: Words whose syllables and likelihood a worker remembers.
REMEMBERED = 200_000
#: Mean likelihood of a letter (log2) from which a text is English, and from which it is if this share of its words is frequent in every band; letters of other scripts there may be.
SURELY, MAYBE, FREQUENT_SHARE, OTHER_SHARE = -3.3, -4.2, 0.12, 0.05
#: Words of a band's most frequent ones that must be so in every band.
FREQUENT = 60

ABBREVIATIONS = frozenset("approx vol fig no nos dr mr mrs ms prof st vs etc cf al resp max min incl dept e g i".split())
#: (needed character, pattern, replacement) in order: tags, entities, list marks, abbreviations, points inside numbers, marks between unpunctuated sentences.
CLEANING = (
    ("<", r"</?[A-Za-z!][^<>\n]*>", " "),
    ("&", r"&nbsp;", " "),
    ("&", r"&amp;", "and"),
    ("&", r"&#?[A-Za-z0-9]{1,8};", " "),
    ("", r"(?m)^[ \t]*(?:[-*+•–#>]+|[0-9]{1,3}[.)])[ \t]+", ""),
    ("", r"[.,](?<=[0-9].)(?=[0-9])", ""),
    ("", r"[-/|•–](?<=[ \t].)(?:(?<=-)-+|(?<!-)[/|]*)[ \t]", "\n"),
)
PATTERNS = tuple((need, re.compile(pattern), new) for need, pattern, new in CLEANING)
LAST_WORD = re.compile(r"[A-Za-z]+$")
WORD, SENTENCE = re.compile("[a-z]+"), re.compile(r"[a-z][^.!?\n]*")
#: Letters of scripts or alphabets other than ASCII's; typographic signs are not among them.
OTHER = re.compile("[^\x00-\xbf -⯿]")


class Profile:
    """Letter triples of a language's words, with blanks around them, and words that are frequent whatever the level."""

    def __init__(self, triples: dict[str, int], frequent: frozenset[str]) -> None:
        self.triples, self.frequent = triples, frequent
        self.starts, self.letters = Counter(), Counter()
        for triple, n in triples.items():
            self.starts[triple[:2]] += n
            self.letters[triple[2]] += n
        self.total = sum(self.letters.values())

    def likelihood(self, word: str) -> float:
        """log2 of the probabilities of all letters of a word and the blank after it, but for its first letter's."""
        total, marked = 0.0, f" {word} "
        for i in range(len(word)):
            triple = marked[i : i + 3]
            single = (self.letters[triple[2]] + 0.5) / (self.total + 14)
            total += math.log2((self.triples.get(triple, 0) + 4 * single) / (self.starts[triple[:2]] + 4))
        return total


def cleaned(text: str) -> str:
    for need, pattern, new in PATTERNS:
        if need in text:
            text = pattern.sub(new, text)
    return _without_abbreviations(text).replace("'", "").replace("’", "").replace("ʼ", "").replace("\r", "\n")


def _without_abbreviations(text: str) -> str:
    """Drop the full stop after an abbreviation."""
    parts = text.split(".")
    for i, part in enumerate(parts[:-1]):
        word = LAST_WORD.search(part[-8:])
        if not (word and word[0].lower() in ABBREVIATIONS):
            parts[i] = part + "."
    return "".join(parts)


def edge_lines(text: str) -> list[tuple[int, int]]:
    """Digests of the first and last line of a cleaned text of several lines, each with that of the lines between them, or of the other one if there are none between."""
    lines = text.strip().split("\n")
    if len(lines) < 2:
        return []
    between = "\n".join(lines[1:-1])
    return [(_digest(lines[0]), _digest(between or lines[-1])), (_digest(lines[-1]), _digest(between or lines[0]))]


def inner_lines(text: str) -> list[int]:
    """Digests of the distinct lines between the first and the last one."""
    return list({_digest(line) for line in text.strip().split("\n")[1:-1]})


def _digest(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.strip().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def without_banners(text: str, known) -> str:
    """Drop the first and the last line if ``known`` holds their digests; one line at least stays."""
    text = text.strip()
    if "\n" in text and known:
        first, rest = text.split("\n", 1)
        if _digest(first) in known:
            text = rest.strip()
    if "\n" in text and known:
        rest, last = text.rsplit("\n", 1)
        if _digest(last) in known:
            text = rest
    return text


def counts(text: str, known, memory: dict[str, tuple[int, float]], profile: Profile) -> tuple:
    """(words, sentences, syllables, words of three syllables or more, letters, is it English)."""
    body = without_banners(cleaned(text), known)
    lower = body.lower()
    words = Counter(WORD.findall(lower))
    n = sum(words.values())
    if not n:
        return 0, 0, 0, 0, 0, False
    said = long = letters = frequent = 0
    likely = 0.0
    for word, times in words.items():
        about = memory.get(word)
        if about is None:
            about = (syllables(word), profile.likelihood(word))
            if len(memory) < REMEMBERED and len(word) <= 40:
                memory[word] = about
        said += about[0] * times
        likely += about[1] * times
        letters += len(word) * times
        if about[0] >= 3:
            long += times
        if word in profile.frequent:
            frequent += times
    other = 0 if body.isascii() else len(OTHER.findall(body))
    mean = likely / letters
    is_english = profile.total > 0 and other < OTHER_SHARE * letters and (mean >= SURELY or (mean >= MAYBE and frequent >= FREQUENT_SHARE * n))
    return n, len(SENTENCE.findall(lower)), said, long, letters, is_english


def banners(documents: DataFrame, text: str = "text", texts: int = BANNER_TEXTS, edge: float = BANNER_EDGE) -> DataFrame:
    """(digest) of the banner lines. A line counts once per distinct rest of the text, so copies of a text, whatever their number, make no banner of its own lines."""

    @F.pandas_udf("struct<whole:bigint,edges:array<struct<digest:bigint,rest:bigint>>,inner:array<bigint>>")
    def lines_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            clean = [cleaned(t) if t else "" for t in some]
            yield pd.DataFrame({"whole": [_digest(t) for t in clean], "edges": [[{"digest": d, "rest": r} for d, r in edge_lines(t)] for t in clean], "inner": [inner_lines(t) for t in clean]})

    lines = documents.where(F.length(text) > 0).select(lines_of(F.col(text)).alias("_e"))
    distinct = lines.where(F.size("_e.edges") > 0).groupBy("_e.whole").agg(F.first("_e.edges").alias("edges"), F.first("_e.inner").alias("inner"))
    distinct = materialize(distinct, "edge-lines")
    at_edges = distinct.select(F.explode("edges").alias("_l")).select("_l.digest", "_l.rest").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= texts)
    at_edges = materialize(at_edges, "frequent-edges")
    between = checked_join(distinct.select(F.explode("inner").alias("digest")), at_edges.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("n_inner"))
    return at_edges.join(between, "digest", "left").where(F.col("n") >= edge * (F.col("n") + F.coalesce("n_inner", F.lit(0)))).select("digest")


def _with_own_banners(documents: DataFrame, text: str, digests: DataFrame, name: str) -> DataFrame:
    """Add the digests among the text's first and last line that are banners, by joins: for more banners than are broadcast as one set."""

    @F.pandas_udf("struct<first:bigint,last:bigint>")
    def ends(some: pd.Series) -> pd.DataFrame:
        found = [edge_lines(cleaned(t)) if t else [] for t in some]
        return pd.DataFrame({"first": pd.array([f[0][0] if f else None for f in found], dtype="Int64"), "last": pd.array([f[1][0] if f else None for f in found], dtype="Int64")})

    marked = documents.withColumn("_ends", ends(F.col(text))).select(*documents.columns, F.col("_ends.first").alias("_first"), F.col("_ends.last").alias("_last"))
    for end in ("_first", "_last"):
        marked = marked.join(digests.select(F.col("digest").alias(end), F.col("digest").alias(f"{end}_known")), end, "left")
    return marked.withColumn(name, F.array_compact(F.array("_first_known", "_last_known"))).select(*documents.columns, name)


def fit_profile(references: DataFrame) -> Profile:
    """The language profile of all reference passages. Words are counted in the executors; the driver gets letter triples and ``FREQUENT`` words at most. Equally frequent words rank by the first passage, by its hash, that has them, and their place in it."""

    @F.pandas_udf("array<struct<word:string,n:bigint,place:bigint>>")
    def words_of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"word": word, "n": n, "place": i} for i, (word, n) in enumerate(Counter(WORD.findall(cleaned(text).lower())).items())] for text in texts])

    listed = references.where("text is not null").select(F.col("level_band").alias("band"), F.xxhash64("text").alias("_h"), F.explode(words_of("text")).alias("_w"))
    words = materialize(listed.groupBy("band", "_w.word").agg(F.sum("_w.n").alias("n"), F.min(F.struct("_h", "_w.place")).alias("first")), "reference-words")
    triple = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.concat(F.lit(" "), "word", F.lit(" ")), i, F.lit(3))))
    triples = {r["triple"]: r["n"] for r in words.select(triple.alias("triple"), "n").groupBy("triple").agg(F.sum("n").alias("n")).collect()}  # 27 ** 3 at most
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("n"), "first", "word"))
    top = words.withColumn("_rn", rank).where(F.col("_rn") <= FREQUENT)
    everywhere = top.groupBy("word").agg(F.count(F.lit(1)).alias("bands")).where(F.col("bands") == words.select("band").distinct().count())
    return Profile(triples, frozenset(r["word"] for r in everywhere.collect()))


MEASURES = "n_words double, n_sentences double, n_syllables double, n_long double, n_letters double, is_english boolean"


def measures(documents: DataFrame, profile: Profile, text: str = "text", banner_digests: DataFrame | None = None) -> DataFrame:
    """Add n_words, n_sentences, n_syllables, n_long (three syllables or more), n_letters and is_english, not counting banner lines."""
    spark = documents.sparkSession
    names = [part.split()[0] for part in MEASURES.split(", ")]
    kept = documents.drop(*names)
    known: frozenset[int] = frozenset()
    own = F.array().cast("array<bigint>")
    if banner_digests is not None:
        few = banner_digests.limit(BROADCAST_ROWS + 1).collect()
        if len(few) <= BROADCAST_ROWS:
            known = frozenset(r["digest"] for r in few)
        else:
            kept, own = _with_own_banners(kept, text, banner_digests, "_banners"), F.col("_banners")
    shared = spark.sparkContext.broadcast((known, profile))  # BROADCAST_ROWS digests at most; a profile is bounded by the alphabet

    @F.pandas_udf(MEASURES)
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        memory: dict[str, tuple[int, float]] = {}
        digests, fitted = shared.value
        for texts, own_banners in batches:
            frame = pd.DataFrame([counts(t or "", digests or frozenset(b), memory, fitted) for t, b in zip(texts, own_banners)], columns=names)
            yield frame.astype({name: "float64" for name in names[:-1]})

    # marked non-deterministic: a filter on the result would else be pushed below and run the function twice
    columns = [c for c in kept.columns if c != "_banners"]
    return kept.withColumn("_m", measure.asNondeterministic()(F.col(text), own)).select(*columns, "_m.*")


def with_grade(documents: DataFrame, profile: Profile, text: str = "text", banner_digests: DataFrame | None = None) -> DataFrame:
    """Add the measures, the five estimates and ``grade``, their median."""
    w, s, y, p, c = (F.when(F.col("n_words") > 0, F.col(name)) for name in ("n_words", "n_sentences", "n_syllables", "n_long", "n_letters"))
    estimates = {
        "flesch_kincaid": 0.39 * w / s + 11.8 * y / w - 15.59,
        "gunning_fog": 0.4 * (w / s + 100 * p / w),
        "smog": 1.043 * F.sqrt(30 * p / s) + 3.1291,
        "coleman_liau": 5.88 * c / w - 29.6 * s / w - 15.8,
        "ari": 4.71 * c / w + 0.5 * w / s - 21.43,
    }
    graded = measures(documents, profile, text, banner_digests).withColumns(estimates)
    return graded.withColumn("grade", F.get(F.array_sort(F.array(*estimates)), F.lit(2)))


def band_limits(references: DataFrame, profile: Profile) -> DataFrame:
    """(level_band, below): documents graded under ``below`` and not under that of a lower band are in the band.

    The limit between two bands lies half-way between the ninth decile of the
    lower and the first decile of the upper band's grades. The top band has none.
    """
    deciles = with_grade(references.select("level_band", "text"), profile).groupBy("level_band").agg(F.expr("percentile(grade, array(0.1, 0.9))").alias("_d"))
    low = F.expr("lead(get(_d, 0)) over (order by level_band)")  # a row per band
    return deciles.select("level_band", ((F.get("_d", F.lit(1)) + low) / 2).alias("below"))


def with_level(documents: DataFrame, references: DataFrame, text: str = "text", banner_digests: DataFrame | None = None) -> DataFrame:
    """Add the measures, ``grade`` and ``level_band``. ``banner_digests`` are worked out from the documents where they are not given. The limits are one row, whatever the references' number."""
    profile = fit_profile(references)
    limits = band_limits(references, profile).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("below", F.lit(float("inf"))).alias("below"), "level_band"))).alias("_limits"))
    graded = with_grade(documents, profile, text, banners(documents, text) if banner_digests is None else banner_digests).crossJoin(F.broadcast(materialize(limits, "limits")))
    band = F.get(F.filter("_limits", lambda limit: F.col("grade") < limit["below"]), F.lit(0))["level_band"]
    return graded.withColumn("level_band", F.when(F.col("grade").isNotNull(), band)).drop("_limits")


def english_levels(documents: DataFrame, references: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, level_band) of every English document of at least ``min_words`` words."""
    return with_level(documents.select("doc_id", "text"), references).where(F.col("is_english") & (F.col("n_words") >= min_words)).select("doc_id", "level_band")
