"""The cleaning pipeline over documents: every stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents. Rows with equal ids are rows of
their own; the near-duplicate stage keeps one row of each group of texts: the one with the smallest id.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyseries import session
from skyseries.llm import jaccard_join, line_dedup, packing, quality, toxicity
from skyseries.llm.frames import Written, free_name, ship, table
from skyseries.llm.queries import PACKING_TOKENIZER


def _columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from the labels of ``sf_dir``."""
    ship(session.prepare(spark))
    score = free_name(docs, "_toxic")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _columns(toxicity.scored(docs, model, name=score).where(F.col(score) < 0.5), docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(session.prepare(spark))
    return quality.kept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text."""
    ship(session.prepare(spark))
    cleaned = line_dedup.without_boilerplate(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return cleaned if kind is None else cleaned.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts: the one with the smallest id, the first by text if that id repeats.

    Rows that share an id are judged by their own texts; of those without words, one for each id stays. Rows without an
    id stay.
    """
    ship(session.prepare(spark))
    groups = jaccard_join.near_duplicates(docs, by_text=True)
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
        return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    written = Written(spark, "repeated")
    names = [free_name(docs, n) for n in ("_n", "_hi", "_node", "_id", "_group", "_rows")]
    firsts = groups.where("component_id = doc_id").groupBy("doc_id", "component", "n_shingles", "hi", "node").agg(F.count(F.lit(1)).alias("rows"))
    rows = firsts.groupBy("doc_id", "component").agg(F.sum("rows").alias("rows")).select(F.col("doc_id").alias("of"), F.col("component").alias("group"), "rows")
    firsts = firsts.drop("rows").join(rows, F.expr("doc_id = of and component <=> group")).select("n_shingles", "hi", "node", "doc_id", "group", "rows").toDF(*names)
    classed = jaccard_join.with_classes(docs.where("doc_id is not null"), names[:3]).withColumn(names[3], F.col("doc_id").cast("bigint"))
    left = written.put(classed.join(firsts, names[:4]))
    # Rows of one group and id meet as partial smallest values; the others, and those without an id, pass by.
    several = left.where(F.col(names[5]) > 1).groupBy(names[3], names[4])
    several = several.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("text")).alias("row")).select("row.*")
    return _columns(left.where(F.col(names[5]) == 1), docs.columns).unionByName(several).unionByName(docs.where("doc_id is null"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their ids."""
    ship(session.prepare(spark))
    return packing.packed(docs, PACKING_TOKENIZER)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The learned first stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again by the next."""
    written = Written(ship(session.prepare(spark)), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
