"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of l code points is cut into two even segments, of l // 2 and the rest. If
a word of equal length, or one longer, is one edit away, then one of the two
segments is left whole in it: the first at its beginning, the second at its end
(shifted by the difference of the lengths). So each word is indexed by its two
segments, probed by the substrings of words as long and one longer, and what
meets is verified. A segment that many words share (a frequent beginning or
ending) is divided on by the same rule: the edit then lies in what is left of
the word, of which one of two even segments is whole again. The key of the join is
a segment together with such a part, so no group holds all words of a segment,
and large ones are still split by Spark as skewed joins. A pair that meets by
several keys is kept at the first of them, which the two words alone decide.

``near_pairs`` shuffles eight short rows for each distinct word: four it is indexed
by, which also serve as probes of words as long, and four as probe of shorter ones.

A null text has no words, a null id counts as an empty one. Repeated rows count
again. Of near words with equal counts the smallest in code-point order is the
form. Words without near words are their own root. Long texts are cut whole; an
empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5) -> DataFrame:
    """A row for each run of letters of at least ``min_chars``: word (A-Z in lower case). With ``slip``, runs whose checksum with the id is divisible by it lose one code point, as misspellings do."""
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(docs[text_col], F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars)
    ascii_ = F.octet_length("run") == F.length("run")
    runs = runs.select("id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))
    if slip is None:
        return runs.select("word")
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return runs.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_chars)


def counted(words: DataFrame, min_count: int = 3) -> DataFrame:
    """One row per distinct word that occurs often enough: word, n."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _cut(x: Column, at: Column | int, size: Column) -> Column:
    return F.substring(x, F.lit(at) if isinstance(at, int) else at, size)


def _keys(word: str, length: Column) -> list[Column]:
    """Of an indexed word of ``length``, or of a word that is as long or one longer, the four parts that a near word shares with it."""
    x, size = F.col(word), F.length(word)
    a, b = F.floor(length / 2).cast("int"), F.ceil(length / 2).cast("int")
    first, second = _cut(x, 1, a), _cut(x, size - b + 1, b)
    rest, start = _cut(x, a + 1, size - a), _cut(x, 1, size - b)  # what is left of the word beside each

    def halves(left: Column, n: Column, of: Column) -> list[Column]:
        one, two = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
        return [_cut(left, 1, one), _cut(left, of - two + 1, two)]

    return [F.concat_ws("|", F.lit(k), s, part) for k, (s, part) in enumerate([*[(first, h) for h in halves(rest, b, size - a)], *[(second, h) for h in halves(start, a, size - b)]])]


def _rows(words: DataFrame, length: Column) -> DataFrame:
    keys = F.array(*[F.xxhash64(length, k) for k in _keys("word", length)])
    return words.select("word", "n", F.posexplode(keys).alias("path", "key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words one edit apart, once: a, a_n, b, b_n; b is longer, or as long and later in order. ``words``: word, n, distinct."""
    own, longer = _rows(words, F.length("word")), _rows(words, F.length("word") - 1)

    def met(probe: DataFrame, more: Column) -> DataFrame:
        a, b = own.alias("a"), probe.alias("b")
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & more & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
        pairs = pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"), F.col("a.path").alias("path"))
        first = F.lit(None)
        for k, (x, y) in reversed(list(enumerate(zip(_keys("a", F.length("a")), _keys("b", F.length("a")))))):
            first = F.when(x == y, k).otherwise(first)
        return pairs.where(F.col("path") == first).drop("path")

    return met(own, F.col("a.word") < F.col("b.word")).unionByName(met(longer, F.length("b.word") == F.length("a.word") + 1))


def variants(words: DataFrame, pairs: DataFrame, factor: int = 2) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n. The form is the most frequent near word, if at least ``factor`` times as frequent."""
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.struct((-F.col(f"{y}_n")).alias("minus"), F.col(y).alias("word")).alias("near"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*")
    alone = words.select("word", "n", F.lit(None).cast(both.schema["near"].dataType).alias("near"))
    best = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("near"))
    fits = -F.col("near.minus") >= factor * F.col("n")
    return best.select("word", "n", "n_near", F.when(fits, F.col("near.word")).alias("form"), F.when(fits, -F.col("near.minus")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """``variants`` with the root: from a word, its form, that one's form and so on to the last. Counts at least double on the way, so the paths are short; each round doubles the steps taken and ends the loop if no word moved."""
    up = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-up")
    while up.where("moved").limit(1).count():
        on = up.select(F.col("word").alias("via"), F.col("root").alias("on"))
        next_ = up.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved"))
        up = written(next_, "spelling-up")
    roots = up.select(F.col("word").alias("of"), "root")
    return forms.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, factor: int = 2) -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n."""
    words = written(counted(occurrences(docs, slip, id_col, text_col, min_chars), min_count), "spelling-words")
    return rooted(written(variants(words, near_pairs(words), factor), "spelling-forms"))


def oracle_sql() -> str:
    """The registered query in DuckDB: near words by the words left when a code point goes."""
    from .shards import CRC_TABLE, crc_sql

    return f"""select * from (with recursive tab as (select {CRC_TABLE} as t),
r as (select doc_id::varchar as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as w from documents),
d as (select id, w, count(*) as k from r where length(w) >= 5 group by all),
h as (select w, k, {crc_sql("id || ':' || w")} as h from d, tab),
c as (select case when h % 97 = 0 then substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) else w end as word, k from h),
words as (select word, sum(k)::bigint as n from c where length(word) >= 5 group by 1 having sum(k) >= 3),
x as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
dels as (select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest from x),
near as (select a.word, b.word as other, b.n as m from dels a join dels b on a.i = b.i and a.rest = b.rest and a.word <> b.word
union select a.word, b.word, b.n from dels a join words b on a.rest = b.word union select b.word, a.word, a.n from dels a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from near group by 1),
f as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.m >= 2 * w.n then b.other end as form, case when b.m >= 2 * w.n then b.m end as form_n from words w left join best b using (word)),
s(word, top) as (select word, word from f union all select s.word, f.form from s join f on f.word = s.top where f.form is not null),
root as (select s.word, s.top as root from s join f on f.word = s.top where f.form is null)
select word, form, root, n, n_near, form_n from f join root using (word))"""
