"""Small relations that queries and their SQL both read: driver text rarely triggers a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import spread

#: (doc_id, pos, section_key, text)
SECTIONS = (
    (-1, 0, "Tree > Taxonomy [paragraph 1]", "PLANTAE - TRACHEOPHYTA - LILIOPSIDA - ASPARAGALES - AMARYLLIDACEAE - Chlidanthus - boliviensis"),
    (-1, 1, "Tree > Range [paragraph 1]", "The <i>CHLIDANTHUS</i> of Plantae and amaryllidaceae, e.g. the color is Gray at 5km and 10 % & more."),
    (-1, 2, "Tree > Range [paragraph 2]", "The IUCN says colour (Smith, 2001) and (Jones 2002) in the 1990's : see spp and sp. for Dr. Mills ; 30 percent or 4 per cent."),
    (-1, 3, "Tree > Bibliography [paragraph 1]", "Smith & Co, 2001 & more. 5 - 10"),
    (-1, 4, "Tree [table 1] [row 1]", "x et al | & 7 sq km | 8 km2"),
    (-2, 0, "Bush > Notes [paragraph 1]", "Mr. Gray's neighbor organised 2000 s of it; the CE center recognises 12 sqkm, 3 m2, 7 cm2 & 9 mm2."),
    (-2, 1, "Bush > Notes [paragraph 2]", "KINGDOM - PHYLUM - CLASS - ORDER - FAMILY - Primus - secundus"),
    (-2, 2, "Bush > Notes [paragraph 3]", "PRIMUS Secundus <em>secundus</em> and ariruma in (Brown et al., 1999)."),
    (-4, 0, "Fern > Range [paragraph 1]", "Kept in situ and <i>in situ</i> and ex. situ on 2nd of March 2001 and the 31st Feb, in the nineteenth century or twenty-first century."),
    (-4, 1, "Fern > Range [paragraph 2]", "For example it has an Extent of Occurrence of 2500000 there, for example, in Vietnam and burma, and for example in South Asia. Extent of occurrence rose to 1234567."),
    (-4, 2, "Fern > Range [paragraph 3]", "It grows from North Ridge to Upper Valley at 5 degrees N, 12 ° S, 7°n and 20 degrees Celsius. 12 plants etc remain; Prof Li (pers comm) and in litt said so, i.e. etc. of them."),
    (-3, 0, "Assessment information [paragraph 1]", "Rock & stone, the  iucn and spp in Ms. Lee's theater."),
)
#: (query_id, text)
QUESTIONS = (
    (1, "What is the EOO threshold under criterion B?"), (2, "How many locations qualify for B2?"), (3, "What does D2 require?"),
    (4, "Which extinction probability counts?"), (5, "mature individuals cutoff"), (6, "criterion a"), (7, "Where is it found?"),
    (8, "What supporting information do I need beyond the basics?"), (9, "AOO and EOO for C1"),
)
#: (name, scope)
TASK_RULES = (("r1", "full_document"), ("r2", "relevant_sections: Threats, Red List Assessment"), ("r3", "section_type:*"), ("r4", "relevant_sections: All, Bibliography"), ("r5", "relevant_sections: None such"))
#: (doc_id, pos, title)
PARTS = (("a", 0, "Threats"), ("a", 1, "Redlist Assessment"), ("a", 2, "Bibliography"), ("b", 0, "Habitat"))


def _sql(v: object) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows: tuple, columns: str) -> str:
    """The rows as a SQL relation."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") AS t({columns}))"


def frame(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each as one section, and the fixture's sections."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).selectExpr("doc_id", "0 AS pos", "concat('Document ', doc_id, ' [paragraph 1]') AS section_key", "text")
    return docs.unionByName(frame(spark, SECTIONS, "doc_id long, pos int, section_key string, text string"))


SECTIONS_SQL = "(SELECT doc_id, 0 AS pos, 'Document ' || doc_id || ' [paragraph 1]' AS section_key, text FROM documents UNION ALL SELECT * FROM " + values(SECTIONS, "doc_id, pos, section_key, text") + ")"
