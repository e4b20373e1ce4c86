"""Canonical tables: column and file aliases, projected scans, defaults, integrity checks and bundles."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import assert_subset, assert_unique
from ..operators.mining import catalog_subset, group_sample
from . import contracts

# Accepted names, and the columns of each table.
COLUMN_ALIASES = {
    "id": ("id", "pair_id", "row_id", "pairid"),
    "term_id": ("term_id", "query_id", "search_term_id", "termid", "queryid"),
    "item_id": ("item_id", "product_id", "sku", "productid", "itemid"),
    "query": ("query", "term", "search_term", "search_query", "query_text"),
    "label": ("label", "target", "relevance", "is_relevant", "prediction"),
    "prediction": ("prediction", "label", "target", "relevance"),
    "title": ("title", "item_title", "product_title", "name", "product_name"),
    "category": ("category", "category_path", "category_name", "taxonomy"),
    "brand": ("brand", "brand_name", "manufacturer"),
    "gender": ("gender", "sex", "cinsiyet"),
    "age_group": ("age_group", "age", "agegroup", "yas_grubu"),
    "attributes": ("attributes", "attribute", "attrs", "product_attributes", "features"),
}
FILE_ALIASES = {
    "items": ("items.csv", "products.csv", "catalog.csv"),
    "terms": ("terms.csv", "queries.csv", "search_terms.csv"),
    "training_pairs": ("training_pairs.csv", "train_pairs.csv", "train.csv"),
    "submission_pairs": ("submission_pairs.csv", "test_pairs.csv", "test.csv"),
    "sample_submission": ("sample_submission.csv", "submission_sample.csv"),
}
TABLE_COLUMNS = {
    "items": ("item_id", "title", "category", "brand", "gender", "age_group", "attributes"),
    "terms": ("term_id", "query"),
    "training_pairs": ("id", "term_id", "item_id", "label"),
    "submission_pairs": ("id", "term_id", "item_id"),
    "sample_submission": ("id", "prediction"),
}
OPTIONAL_COLUMNS = {
    "items": {"category", "brand", "gender", "age_group", "attributes"},
    "training_pairs": {"id", "label"},
    "sample_submission": {"prediction"},
}
DEFAULTS = {"label": 1, "prediction": 0}
NUMERIC = {"label": "tinyint", "prediction": "tinyint"}


def alias_key(name: str) -> str:
    """Letters and digits of the name, without accents, in lower case."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]", "", plain)


def resolve_column(columns: list[str], canonical: str, required: bool = True) -> str | None:
    """The one column that stands for a canonical name; two candidates are an error, even if one has the canonical name itself."""
    accepted = {alias_key(a) for a in (canonical, *COLUMN_ALIASES.get(canonical, ()))}
    found = [c for c in columns if alias_key(c) in accepted]
    if len(found) > 1:
        raise ValueError(f"{canonical}: ambiguous columns {found}")
    if not found and required:
        raise ValueError(f"{canonical}: none of {columns} matches")
    return found[0] if found else None


def discover(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the canonical tables in a folder of any file system Spark reads; two files for one table are an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    names = {s.getPath().getName().lower(): s.getPath().toString() for s in root.getFileSystem(conf).listStatus(root)}
    out = {}
    for table, accepted in FILE_ALIASES.items():
        found = [names[a] for a in accepted if a in names]
        if len(found) > 1:
            raise ValueError(f"{table}: ambiguous files {found}")
        if found:
            out[table] = found[0]
    return out


def canonical(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns, renamed, as text but for the numeric ones, with defaults for absent optional ones.

    Only these columns reach the scan.  A number that cannot be read is an error when the rows are used.
    """
    optional = OPTIONAL_COLUMNS.get(table, set())
    out = []
    for name in TABLE_COLUMNS[table]:
        source = resolve_column(df.columns, name, required=name not in optional)
        kind = NUMERIC.get(name, "string")
        if source is None:
            default = F.lit(DEFAULTS.get(name, "")) if name != "id" else F.lit(None)
            out.append(default.cast(kind).alias(name))
        else:
            value = F.col(f"`{source}`").cast(kind)
            out.append((F.coalesce(value, F.lit("")) if name in optional and kind == "string" and name != "id" else value).alias(name))
    return df.select(*out)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text, or parquet, by suffix."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=False, escape='"', quote='"')
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"{path}: neither .csv nor .parquet")


def read_canonical(spark: SparkSession, path: str, table: str) -> DataFrame:
    return canonical(read_any(spark, path), table)


@dataclass(frozen=True)
class AuditConfig:
    debug_items: int | None = None
    sample_pairs: int | None = None
    seed: str = "42"

    def __post_init__(self):
        for name in ("debug_items", "sample_pairs"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class Bundle:
    items: DataFrame
    terms: DataFrame
    training_pairs: DataFrame
    submission_pairs: DataFrame
    sample_submission: DataFrame


def load_bundle(spark: SparkSession, folder: str, config: AuditConfig | None = None, validate: bool = True) -> Bundle:
    config = config or AuditConfig()
    paths = discover(spark, folder)
    missing = set(FILE_ALIASES) - set(paths)
    if missing:
        raise FileNotFoundError(f"{folder}: no file for {sorted(missing)}")
    t = {name: read_canonical(spark, path, name) for name, path in paths.items()}
    if config.sample_pairs:
        t["submission_pairs"] = group_sample(t["submission_pairs"], "term_id", config.sample_pairs, config.seed)
        t["sample_submission"] = t["sample_submission"].join(t["submission_pairs"].select("id"), "id", "left_semi")
    if config.debug_items:
        referenced = t["training_pairs"].select("item_id").unionByName(t["submission_pairs"].select("item_id")).distinct()
        t["items"] = catalog_subset(t["items"], referenced, "item_id", config.debug_items)
    bundle = Bundle(**{name: t[name] for name in FILE_ALIASES})
    if validate:
        validate_bundle(bundle)
    return bundle


def validate_bundle(b: Bundle) -> None:
    for name, df, keys in (("items", b.items, ["item_id"]), ("terms", b.terms, ["term_id"]), ("submission_pairs", b.submission_pairs, ["id"])):
        assert_unique(df, keys, name)
        contracts.require([contracts.failing(df, F.col(keys[0]).isNotNull(), f"{name}.{keys[0]}")])
    for name, pairs in (("training_pairs", b.training_pairs), ("submission_pairs", b.submission_pairs)):
        assert_unique(pairs, ["term_id", "item_id"], name)
        assert_subset(pairs, b.terms, ["term_id"], name)
        assert_subset(pairs, b.items, ["item_id"], name)
    contracts.require([contracts.failing(b.training_pairs, F.col("label").isin(0, 1), "label_domain")])
    assert_subset(b.submission_pairs, b.sample_submission, ["id"], "sample_submission")
    assert_subset(b.sample_submission, b.submission_pairs, ["id"], "submission_pairs")
