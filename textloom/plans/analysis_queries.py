"""Queries of the corpus analyses and sequence statistics, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import codecs as C
from textloom.operators import analysis as A
from textloom.operators import sequence as S
from textloom.operators.grams import counted
from textloom.session import table

WORDS = r"unnest(regexp_extract_all(lower(text), '\w+'))"
CHARS = "unnest(string_split(text, ''))"
CLASSES = tuple(c for c in A.TOKEN_CLASSES if c[0] not in ("proper", "date"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(A.frequency(docs(spark, sf_dir), A.word_tokens(F.col("text")), "word"), "n", "word")


def word_page_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(A.page_frequency(docs(spark, sf_dir), A.word_tokens(F.col("text")), "word"), "pages", "word")


def word_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(A.burstiness(docs(spark, sf_dir), A.word_tokens(F.col("text")), "word"), "score", "word")


def mixed_case_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.matches(F.expr("concat(text, ' i', upper(lang), ' d', upper(source))"), " [a-z]+[A-Z]")
    return A.frequency(docs(spark, sf_dir), found, "word").orderBy(F.desc("n"), "word")


def char_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(A.frequency(docs(spark, sf_dir), A.code_points(F.col("text")), "c").where(A.not_ascii("c")), "n", "c")


def char_page_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(A.page_frequency(docs(spark, sf_dir), A.code_points(F.col("text")), "c").where(A.not_ascii("c")), "pages", "c")


def char_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(A.burstiness(docs(spark, sf_dir), A.code_points(F.col("text")), "c").where(A.not_ascii("c")), "score", "c")


def codepoint_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.frequency(docs(spark, sf_dir), A.code_points(F.col("text")), "c").select(F.ascii("c").alias("code_point"), "n")
    return A.top(found, "n", "code_point", 200)


def unused_codepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unused_code_points(docs(spark, sf_dir), F.col("text"))


def token_class_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.token_class_transitions(docs(spark, sf_dir), F.col("text"), CLASSES)


def token_class_transitions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.token_class_transitions(docs(spark, sf_dir), F.col("text"))


def ngram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gram_counts(docs(spark, sf_dir), F.col("text")).select("gram", F.length("gram").alias("size"), "n")


def symbol_pattern_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(A.symbol_patterns(table(spark, sf_dir, "pages"), F.col("html")), "saved", "pattern")


def separator_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_separators(docs(spark, sf_dir), F.col("text"))


def separator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.separator_stats(docs(spark, sf_dir), F.col("text"), separator_mining(spark, sf_dir))
    return found.select("sep", "n", "lo", "hi", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "score"))).orderBy(F.desc("score"), "sep").limit(20)


def compact_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.compact_words(F.col("text")).alias("skeleton"))


def can_spare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(docs(spark, sf_dir), C.compact_words(F.col("text")), range(1, 11), "pattern").withColumn("saved", C.can_spare(F.col("pattern"), F.col("n")))


def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.char_vocab(docs(spark, sf_dir), F.col("text"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.perplexity(docs(spark, sf_dir), "doc_id", F.col("text")).select("doc_id", F.round("perplexity", 6).alias("perplexity"))


def hmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hmm_fit(docs(spark, sf_dir), F.col("text")).select("kind", "from_state", "to", "n", F.round("p", 9).alias("p"))


def likely_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.likely_substrings(docs(spark, sf_dir), F.col("text"))


def story_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("role", F.explode(A.word_tokens(F.col("text"))).alias("word"))
    return said.groupBy("role", "word").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        word_freq, word_page_freq, word_burstiness, mixed_case_words, char_freq, char_page_freq, char_burstiness, codepoint_freq, unused_codepoints,
        token_class_transitions, token_class_transitions_all, ngram_count, symbol_pattern_mining, separator_mining, separator_stats, compact_words,
        can_spare, char_vocab, perplexity, hmm_fit, likely_substrings, story_vocab,
    )
}


def _burst(name: str, tokens: str, where: str) -> str:
    return f"""
        WITH t AS (SELECT doc_id, {tokens} AS {name} FROM documents),
        g AS (SELECT {name}, count(*) AS n, count(DISTINCT doc_id) AS pages FROM t {where} GROUP BY {name})
        SELECT {name}, n, pages, n // (1 + pages) AS score FROM g ORDER BY score DESC, {name} LIMIT 100"""


def _skeleton(text: str) -> str:
    out = rf"regexp_replace(regexp_replace({text}, '\w+( \w+)+', chr(1), 'g'), '\w+', 'w', 'g')"
    out = f"replace({out}, chr(1), 'z')"
    return rf"regexp_replace({out}, '((w,|z[.,]) )*z', 'z', 'g')"


def _spare(pattern: str) -> str:
    letters = f"regexp_replace({pattern}, '[^wz]', '', 'g')"
    words = f"length(replace({letters}, 'z', ''))"
    lists = f"(length({letters}) - {words})"
    return f"(length({pattern}) - ({words} + 2 * {lists} + length(regexp_extract({letters}, '^(z*)', 1)) + CASE WHEN {letters} = '' OR {letters}[1] = 'w' THEN 1 ELSE 0 END))"


_SUBS = "SELECT unnest(flatten([[substr(s, i, k) for i in range(1, length(s) - k + 2)] for k in range({low}, {high} + 1)])) AS {name} FROM rows_"
_plain = lambda p: p.replace("*+", "*").replace("++", "+").replace("'", "''").replace(r"\v", r"\n")  # noqa: E731  RE2 has no possessive repeats and needs none
_kind = "CASE " + " ".join(f"WHEN regexp_full_match(k, '{_plain(p)}', 's') THEN '{n}'" for n, p in CLASSES) + " END"
_joined = "|".join(_plain(p) for _, p in CLASSES)
_state = r"CASE WHEN regexp_full_match(c, '\p{L}') THEN 'letter' WHEN regexp_full_match(c, '\p{Nd}') THEN 'digit' ELSE c END"

_bordered = " OR ".join(f"(length(gram) > {p} AND left(gram, {p}) = right(gram, {p}))" for p in range(1, 5))
#: What cannot overlap itself is counted place by place, all else by what a text loses with it.
GRAMS = f"""
        rows_ AS (SELECT doc_id, text AS s FROM documents),
        g AS (SELECT doc_id, s, unnest(flatten([[substr(s, i, k) for i in range(1, length(s) - k + 2)] for k in range(2, 6)])) AS gram FROM rows_),
        own AS (SELECT DISTINCT doc_id, s, gram FROM g WHERE {_bordered}),
        grams AS (SELECT gram, count(*) AS n FROM g WHERE NOT ({_bordered}) GROUP BY gram
                  UNION ALL SELECT gram, sum((length(s) - length(replace(s, gram, ''))) // length(gram))::BIGINT AS n FROM own GROUP BY gram)"""
#: A string of over eight characters is no commoner than its first eight, so only what begins commonly enough is followed up to 63.
_MINED = f"""
        rows_ AS MATERIALIZED (SELECT text AS s FROM documents), p AS ({_SUBS.format(low=1, high=8, name="sep")}),
        f AS MATERIALIZED (SELECT sep, count(*) AS n FROM p GROUP BY sep HAVING count(*) > 1),
        least AS (SELECT min(n) AS t FROM (SELECT n FROM f WHERE length(sep) < 8 AND NOT EXISTS (SELECT 1 FROM (SELECT left(sep, -1) AS inner_, n FROM f UNION SELECT substr(sep, 2), n FROM f) l WHERE l.inner_ = f.sep AND l.n = f.n) ORDER BY n DESC LIMIT 100)),
        begun AS (SELECT s, unnest(range(1, length(s) - 7)) AS i FROM rows_),
        long_ AS (SELECT unnest([substr(s, i, k) for k in range(9, least(64, length(s) - i + 2))]) AS sep FROM (SELECT s, i FROM begun WHERE substr(s, i, 8) IN (SELECT sep FROM f, least WHERE length(sep) = 8 AND n >= t))),
        every AS (SELECT sep, n FROM f UNION ALL SELECT sep, count(*) AS n FROM long_ GROUP BY sep HAVING count(*) > 1),
        mined AS (SELECT sep, n FROM every WHERE NOT EXISTS (SELECT 1 FROM (SELECT left(sep, -1) AS inner_, n FROM every UNION SELECT substr(sep, 2), n FROM every) l WHERE l.inner_ = every.sep AND l.n = every.n) ORDER BY n DESC, sep LIMIT 100)"""

ORACLES = {
    "word_freq": f"SELECT word, count(*) AS n FROM (SELECT {WORDS} AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 100",
    "word_page_freq": f"SELECT word, count(DISTINCT doc_id) AS pages FROM (SELECT doc_id, {WORDS} AS word FROM documents) GROUP BY word ORDER BY pages DESC, word LIMIT 100",
    "word_burstiness": _burst("word", WORDS, ""),
    "mixed_case_words": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(concat(text, ' i', upper(lang), ' d', upper(source)), ' [a-z]+[A-Z]')) AS word FROM documents) GROUP BY word",
    "char_freq": f"SELECT c, count(*) AS n FROM (SELECT {CHARS} AS c FROM documents) WHERE unicode(c) >= 127 GROUP BY c ORDER BY n DESC, c LIMIT 100",
    "char_page_freq": f"SELECT c, count(DISTINCT doc_id) AS pages FROM (SELECT doc_id, {CHARS} AS c FROM documents) WHERE unicode(c) >= 127 GROUP BY c ORDER BY pages DESC, c LIMIT 100",
    "char_burstiness": _burst("c", CHARS, "WHERE unicode(c) >= 127"),
    "codepoint_freq": f"SELECT unicode(c) AS code_point, count(*) AS n FROM (SELECT {CHARS} AS c FROM documents) WHERE c <> '' GROUP BY 1 ORDER BY n DESC, code_point LIMIT 200",
    "unused_codepoints": f"SELECT i::INT AS code_point FROM range(512) t(i) WHERE i NOT IN (SELECT unicode(c) FROM (SELECT DISTINCT {CHARS} AS c FROM documents) WHERE c <> '')",
    "token_class_transitions": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_joined}') AS ks FROM documents),
        u AS (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS pos FROM t),
        c AS (SELECT doc_id, pos, {_kind} AS kind FROM u),
        m AS (SELECT kind AS from_class, lead(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS to_class FROM c),
        g AS (SELECT from_class, to_class, count(*) AS n FROM m WHERE to_class IS NOT NULL GROUP BY ALL)
        SELECT from_class, to_class, n, floor(100 * n / sum(n) OVER (PARTITION BY from_class))::BIGINT AS percent FROM g""",
    "ngram_count": f"WITH {GRAMS} SELECT gram, length(gram)::INT AS size, n FROM grams",
    "symbol_pattern_mining": f"""
        WITH u AS (SELECT replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h FROM pages),
        rows_ AS (SELECT {_skeleton("h")} AS s FROM u), p AS ({_SUBS.format(low=2, high=10, name="pattern")}),
        g AS (SELECT pattern, count(*) AS n FROM p GROUP BY pattern)
        SELECT pattern, n, n * {_spare("pattern")} AS saved FROM g WHERE {_spare("pattern")} > 0 ORDER BY saved DESC, pattern LIMIT 100""",
    "separator_mining": f"WITH {_MINED} SELECT sep, n FROM mined",
    "separator_stats": rf"""
        WITH {_MINED},
        parts AS (SELECT doc_id, sep, string_split(text, sep) AS gaps FROM documents, mined WHERE contains(text, sep)),
        u AS (SELECT doc_id, sep, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS k, len(gaps) AS m FROM parts),
        places AS (SELECT sep, k, m, sum(length(gap)) OVER (PARTITION BY doc_id, sep ORDER BY k) + (k - 1) * length(sep) AS place FROM u),
        g AS (SELECT sep, count(*) AS n, min(place)::INT AS lo, max(place)::INT AS hi, avg(place) AS mean, stddev_pop(place) AS sd FROM places WHERE k < m GROUP BY sep)
        SELECT sep, n, lo, hi, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN sd > 0 THEN (hi - lo) / sd * length(sep) * ln(n) ELSE 0 END, 6) AS score
        FROM g ORDER BY score DESC, sep LIMIT 20""",
    "compact_words": f"SELECT doc_id, {_skeleton('text')} AS skeleton FROM documents",
    "can_spare": f"WITH rows_ AS (SELECT {_skeleton('text')} AS s FROM documents), p AS ({_SUBS.format(low=1, high=10, name='pattern')}), g AS (SELECT pattern, count(*) AS n FROM p GROUP BY pattern) SELECT pattern, n, n * {_spare('pattern')} AS saved FROM g",
    "char_vocab": f"SELECT unicode(c) AS code_point, count(*) AS n FROM (SELECT {CHARS} AS c FROM documents) WHERE c <> '' GROUP BY 1",
    "perplexity": """
        WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 1),
        u AS (SELECT doc_id, unnest(c[:-2]) AS a, unnest(c[2:]) AS b FROM c), g AS (SELECT a, b, count(*) AS n FROM u GROUP BY ALL),
        m AS (SELECT a, b, -log2(n / sum(n) OVER (PARTITION BY a)) AS bits FROM g), own AS (SELECT doc_id, a, b, count(*) AS k FROM u GROUP BY ALL)
        SELECT doc_id, round(pow(2.0, sum(k * bits) / sum(k)), 6) AS perplexity FROM own JOIN m USING (a, b) GROUP BY doc_id""",
    "hmm_fit": f"""
        WITH r AS (SELECT doc_id, string_split(text, '') AS cs FROM documents WHERE text <> ''),
        u AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM r), s AS (SELECT doc_id, i, c, {_state} AS st FROM u),
        x AS (SELECT 'initial' AS kind, '' AS from_state, st AS "to" FROM s WHERE i = 1 UNION ALL SELECT 'emission', st, c FROM s
              UNION ALL SELECT 'transition', st, nx FROM (SELECT st, lead(st) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM s) WHERE nx IS NOT NULL),
        g AS (SELECT kind, from_state, "to", count(*) AS n FROM x GROUP BY ALL)
        SELECT kind, from_state, "to", n, round(n / sum(n) OVER (PARTITION BY kind, from_state), 9) AS p FROM g""",
    "story_vocab": r"SELECT role, word, count(*) AS n FROM (SELECT role, unnest(regexp_extract_all(lower(text), '\w+')) AS word FROM conversations) GROUP BY ALL",
}
