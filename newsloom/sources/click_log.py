"""Sources of click logs and the unified tables made of them.

articles: one row per article. interactions: one row per impression with aligned arrays
``history_ids, candidate_ids, labels``. candidates: one row per shown article. click_history: one
row per timestamped click.
"""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.packed import parse_values
from newsloom.shared import first_rows

SPLITS = ("train", "val", "test")
NEWS_TSV = "id string, category string, subcategory string, title string, abstract string, url string, title_entities string, abstract_entities string"
BEHAVIORS_TSV = "id string, user_id string, time string, history string, impressions string"
VECTOR_SIZE = 100


# -- scans --
def news_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """Headerless tab-separated news without quoting; empty fields are NULL."""
    return spark.read.schema(NEWS_TSV).option("sep", "\t").option("quote", "").csv(list(paths))


def behaviors_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """Headerless tab-separated impressions; an unreadable time is NULL."""
    raw = spark.read.schema(BEHAVIORS_TSV).option("sep", "\t").option("quote", "").csv(list(paths))
    t = F.try_to_timestamp(F.col("time"), F.lit("M/d/yyyy h:mm:ss a")).cast("timestamp_ntz")
    return raw.withColumn("time", t)


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan of the columns named (all, if none)."""
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d


def table_facts(spark: SparkSession, path: str) -> tuple[list[tuple[str, str]], int]:
    """Names and types of the columns, and the number of rows; both come from the files' footers, no
    column is read."""
    d = spark.read.parquet(path)
    return d.dtypes, d.count()


def sample_json(df: DataFrame, n: int = 3) -> list[str]:
    """The first n rows as indented JSON, to look at (n is the feature)."""
    return [r[0] for r in df.limit(n).select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})).collect()]


def accuracy_rows(behaviors: DataFrame) -> DataFrame:
    """Rows that count for accuracy: those not flagged ``is_beyond_accuracy``, all if there is no such flag."""
    if "is_beyond_accuracy" not in behaviors.columns:
        return behaviors
    return behaviors.where(~F.coalesce("is_beyond_accuracy", F.lit(False)))


def entity_vectors(spark: SparkSession, *paths: str, size: int = VECTOR_SIZE) -> DataFrame:
    """``entity_id, vec`` from tab-separated vector files; of an entity in several files the first
    file's vector counts. Lines with too few numbers drop out."""
    parts = None
    for k, p in enumerate(paths):
        d = spark.read.text(p).select(F.split("value", "\t").alias("f"), F.lit(k).alias("file"))
        d = d.select(F.col("f")[0].alias("entity_id"), F.transform(F.slice("f", 2, size), lambda x: x.try_cast("float")).alias("vec"), "file").where(F.size("vec") == size)
        parts = d if parts is None else parts.unionByName(d)
    return first_rows(parts, ["entity_id"], [F.col("file")]).drop("file")


def extract_if_absent(data_dir: str, name: str) -> str:
    """Unpack ``name.zip`` beside the wanted directory if that is absent; runs on the driver only, before
    any cluster reads the files. Members that would leave the directory are refused."""
    want = os.path.join(data_dir, name)
    if not os.path.isdir(want):
        with zipfile.ZipFile(want + ".zip") as z:
            root = os.path.realpath(want)
            for m in z.namelist():
                if not os.path.realpath(os.path.join(want, m)).startswith(root):
                    raise ValueError(f"{m} leads out of {want}")
            z.extractall(want)
    return want


# -- unified tables --
def entity_ids(json: Column) -> Column:
    """Distinct ids in order of a JSON list of entities; malformed text gives an empty list."""
    parsed = F.from_json(json, "array<struct<WikidataId:string>>")
    return F.coalesce(F.array_distinct(F.filter(F.transform(parsed, lambda e: e["WikidataId"]), lambda x: x.isNotNull())), F.array().cast("array<string>"))


def articles_from_news(news: DataFrame) -> DataFrame:
    both = F.array_distinct(F.concat(entity_ids(F.col("title_entities")), entity_ids(F.col("abstract_entities"))))
    return news.select(F.col("id").alias("article_id"), "title", "abstract", "category", "subcategory", both.alias("entities"), "url")


def articles_from_parquet(raw: DataFrame) -> DataFrame:
    """Raw article columns to the unified ones; optional columns may be missing."""
    has = set(raw.columns)
    category = F.col("category_str") if "category_str" in has else F.col("category").cast("string") if "category" in has else F.lit(None).cast("string")
    sub = F.array_join(F.col("subcategory").cast("array<string>"), ",") if "subcategory" in has else F.lit(None).cast("string")
    ents = F.coalesce(F.col("ner_clusters").cast("array<string>"), F.array().cast("array<string>")) if "ner_clusters" in has else F.array().cast("array<string>")
    pick = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    return raw.select(F.col("article_id").cast("string"), pick("title").alias("title"), pick("subtitle").alias("abstract"), category.alias("category"), sub.alias("subcategory"), ents.alias("entities"), pick("url").alias("url"))


def articles(df: DataFrame) -> DataFrame:
    """One row per article: of repeats the one with a url, then the latest modified, then the lesser
    title. A NULL list of entities is empty."""
    order = [F.col("url").isNull(), F.col("last_modified_time").desc_nulls_last(), F.col("title").asc_nulls_last()]
    one = first_rows(df.where(F.col("article_id").isNotNull()), ["article_id"], order)
    return one.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def union_articles(*parts: DataFrame) -> DataFrame:
    """Union of article tables; of an article in several the first table's row counts."""
    u = None
    for k, p in enumerate(parts):
        q = p.withColumn("__src", F.lit(k))
        u = q if u is None else u.unionByName(q, allowMissingColumns=True)
    return first_rows(u, ["article_id"], [F.col("__src")]).drop("__src")


def split_label(tok: Column) -> Column:
    """(article_id, label) of a shown token: the label follows the last hyphen; none gives NULL."""
    labelled = tok.rlike("-")
    return F.struct(F.when(labelled, F.regexp_extract(tok, r"^(.*)-([^-]*)$", 1)).otherwise(tok).alias("article_id"), F.when(labelled, F.regexp_extract(tok, r"^(.*)-([^-]*)$", 2)).try_cast("int").alias("label"))


def interactions(df: DataFrame, prefix: bool = False) -> DataFrame:
    """One row per impression: of repeats the first that arrived. Tokens whose label is no number are
    left out, tokens without label have a NULL label."""
    one = first_rows(df.where(F.col("impression_id").isNotNull()), ["impression_id"], [F.col("ingested_time").asc_nulls_last(), F.col("impressions").asc_nulls_last()])
    toks = F.filter(parse_values(F.col("impressions"), "ids"), lambda t: ~t.contains("-") | F.regexp_extract(t, r"^(.*)-([^-]*)$", 2).try_cast("int").isNotNull())
    shown = F.transform(toks, split_label)
    ident = F.concat_ws("_", "split", F.col("impression_id").cast("string")) if prefix else F.col("impression_id")
    out = one.withColumn("shown", shown)
    return out.select(
        ident.alias("impression_id"), "user_id", "session_id", F.col("impression_time"), parse_values(F.col("history"), "ids").alias("history_ids"),
        F.transform("shown", lambda x: x["article_id"]).alias("candidate_ids"), F.transform("shown", lambda x: x["label"]).alias("labels"),
        "read_time", "scroll_percentage", "split",
    )


def inview_interactions(behaviors: DataFrame, history: DataFrame, split: str) -> DataFrame:
    """Impressions that carry lists of shown and clicked articles, with one history per user (none:
    empty). The label of a shown article is whether it was clicked; test impressions have none."""
    clicked = F.coalesce(F.col("article_ids_clicked").cast("array<string>"), F.array().cast("array<string>")) if "article_ids_clicked" in behaviors.columns else None
    b = behaviors.withColumn("__c", F.coalesce(F.col("article_ids_inview").cast("array<string>"), F.array().cast("array<string>")))
    lab = F.transform("__c", lambda a: F.array_contains(clicked, a).cast("int")) if clicked is not None else F.transform("__c", lambda a: F.lit(None).cast("int"))
    h = history.select("user_id", F.col("article_id_fixed").cast("array<string>").alias("__h"))
    j = b.withColumn("__l", lab).join(h, "user_id", "left")
    return j.select(F.concat_ws("_", F.lit(split), F.col("impression_id").cast("string")).alias("impression_id"), "user_id", "impression_time", F.coalesce("__h", F.array().cast("array<string>")).alias("history_ids"), F.col("__c").alias("candidate_ids"), F.col("__l").alias("labels"), F.lit(split).alias("split"))


def candidates(inter: DataFrame, *keep: str) -> DataFrame:
    """One row per shown article, ``pos`` from 1 in display order; empty lists give no row."""
    z = F.arrays_zip(F.col("candidate_ids").alias("article_id"), F.col("labels").alias("label"))
    cols = [c for c in ("impression_id", "user_id", "impression_time", "split", *keep) if c in inter.columns]
    e = inter.select(*cols, F.posexplode(z).alias("p", "c"))
    return e.select(*cols, (F.col("p") + 1).alias("pos"), F.col("c.article_id").alias("article_id"), F.col("c.label").alias("label"))


def click_history(inter: DataFrame) -> DataFrame:
    """``user_id, article_id, click_time, split`` of every click with user and time."""
    c = candidates(inter).where("label = 1 AND user_id IS NOT NULL AND impression_time IS NOT NULL")
    return c.select("user_id", "article_id", F.col("impression_time").alias("click_time"), "split")


def history_clicks(history: DataFrame, split: str, order: int) -> DataFrame:
    """Clicks of per-user parallel lists (article, time), with the ordinal of their source for ``first_clicks``."""
    z = history.select("user_id", F.inline(F.arrays_zip(F.col("article_id_fixed").alias("article_id"), F.col("impression_time_fixed").alias("click_time"))))
    return z.select("user_id", F.col("article_id").cast("string").alias("article_id"), "click_time", F.lit(split).alias("split"), F.lit(order).alias("src")).na.drop(subset=["article_id", "click_time"])


def first_clicks(*parts: DataFrame) -> DataFrame:
    """Union of click tables, each (user, article, time) once, from its first source."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return first_rows(u, ["user_id", "article_id", "click_time"], [F.col("src")]).drop("src")
