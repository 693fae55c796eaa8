"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, table


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import media

    return media.digest(media.to_gifs(documents(spark, sf_dir)))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import pii

    return pii.detect(documents(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import jaccard

    return jaccard.link(documents(spark, sf_dir))


def op4_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import phrases

    done = phrases.dedup(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that selection keeps, with their expected grade and tail probabilities."""
    from quillspark.llm import quality

    return quality.grade(documents(spark, sf_dir), table(spark, sf_dir, "labels")).where("selected").drop("selected")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import mixing

    return mixing.plan(documents(spark, sf_dir)).drop("source", "text_hash")


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import lm

    return lm.score(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import langid

    return langid.identify(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import packing

    return packing.pack(documents(spark, sf_dir))


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import fingerprint

    return fingerprint.edits(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gif_media": op1_gif_media,
    "op2_weak_supervision_pii": op2_weak_supervision_pii,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_phrase_dedup": op4_phrase_dedup,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_source_mixing": op6_source_mixing,
    "op7_ppm_scores": op7_ppm_scores,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_fingerprints": op10_minhash_fingerprints,
}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The operators whose whole result SQL can express; the others are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op3_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM d),
    n AS (SELECT doc_id, count(k) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM c JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.x, r.c FROM r JOIN e ON r.doc_id = e.y),
    low AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1), m AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
    SELECT doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM n JOIN low USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op4_phrase_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    f AS (SELECT k, min(doc_id) AS first FROM p GROUP BY 1),
    g AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM p JOIN f USING (k) WHERE first < doc_id), (SELECT unnest(range(13)) AS j)),
    x AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM x ANTI JOIN g USING (doc_id, i) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
