"""Document sources: any table Spark reads, in order, capped per source, as one mixture."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.settings import warn_of_unknown

#: Characters of a text by which rows of one order number are dealt out.
HEAD = 16
SCHEMA = "ord long, text string, source string, kind string, idx long"

@dataclass(frozen=True)
class SourceSpec:
    name: str
    path: str
    format: str = "parquet"
    kind: str = "prose"
    text_key: str = "text"
    order_key: str | None = None
    max_docs: int | None = None
    weight: float = 1.0
    options: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_dict(cls, values: dict) -> "SourceSpec":
        """From a source's settings. ``hf_path`` names a dataset of a hub: a folder of that path is read, below it
        ``data_dir`` or ``hf_config`` and the files of ``split`` where they are given."""
        d = warn_of_unknown("source", values, ("name", "path", "format", "kind", "text_key", "order_key", "max_docs", "weight", "options", "hf_path", "hf_config", "data_dir", "split"))
        known = {k: d[k] for k in ("name", "path", "format", "kind", "text_key", "order_key", "max_docs", "weight") if k in d}
        if "path" not in known:
            if "hf_path" not in d:
                raise ValueError(f"source {d.get('name')!r} has neither path nor hf_path")
            below = [str(d[k]) for k in ("hf_config", "data_dir") if k in d]
            files = f"{d['split']}*" if "split" in d else ""
            known["path"] = "/".join(x for x in (d["hf_path"], *below, files) if x)
        return cls(**known, options=tuple(sorted((d.get("options") or {}).items())))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``idx``, 0 to n - 1 in the order of the partitions: a row's place in its partition and what is before that.

    The table of partition sizes has a row a partition; no task sees more than that or its own partition."""
    placed = rows.withColumn("_m", F.monotonically_increasing_id())  # partition in the upper, place in the lower 33 bits
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return placed.join(starts, "_p").withColumn("idx", F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_s")


def _in_order(rows: DataFrame) -> DataFrame:
    """By ``_o``, then text. The driver finds the ranges of partitions from a sample of what they are cut by, so that is not
    the text but its first few characters, which stand in the same order."""
    return rows.withColumn("_h", F.substring("text", 1, HEAD)).repartitionByRange("_o", "_h").sortWithinPartitions("_o", "text").drop("_h")


def read_source(spark: SparkSession, spec: SourceSpec, limit: int | None = None) -> DataFrame:
    """``idx, text, source, kind`` of one source, numbered without gaps in the order of its key, or else of its files.
    Null and empty texts go before numbering and don't count towards the cap, which is the smaller of max_docs and limit;
    0 is no cap."""
    rows = spark.read.format(spec.format).options(**dict(spec.options)).load(spec.path)
    text = F.col("value" if spec.format == "text" and spec.text_key == "text" else spec.text_key).cast("string")
    order = [F.col(spec.order_key).alias("_o")] if spec.order_key else []
    rows = rows.select(*order, text.alias("text")).where("text is not null and text <> ''")
    rows = _numbered(_in_order(rows) if order else rows)
    caps = [c for c in (spec.max_docs, limit) if c]
    if caps:
        rows = rows.where(F.col("idx") < min(caps))
    return rows.select("idx", "text", F.lit(spec.name).alias("source"), F.lit(spec.kind).alias("kind"))


def read_mixture(spark: SparkSession, specs: list[SourceSpec], limit: int | None = None) -> DataFrame:
    """All sources one behind the other: ``ord`` counts on from source to source without gaps, so it never overflows."""
    parts, start = [], 0
    for i, spec in enumerate(specs):
        part = read_source(spark, spec, limit)
        parts.append(part.withColumn("ord", F.col("idx") + F.lit(start)))
        if i < len(specs) - 1:
            start += part.count()
    return reduce(DataFrame.unionByName, parts).select("ord", "text", "source", "kind", "idx")


def cap_per_source(docs: DataFrame, cap: int | None, order_col: str = "doc_id") -> DataFrame:
    """The first rows of each source by order; Spark limits each map task to the cap before the shuffle."""
    docs = docs.where("text is not null and text <> ''")
    if not cap:
        return docs
    first = Window.partitionBy("source").orderBy(order_col)
    return docs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap).drop("_n")


def weighted_mixture(docs: DataFrame, weights: dict[str, float], seed: int = 0, order_col: str = "ord") -> DataFrame:
    """Down-sample sources by hash so that kept characters are in proportion to the weights, as far as they reach."""
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect() if weights.get(r["source"], 0) > 0 and r["n"]}
    if not sizes:
        return docs.limit(0)
    scale = min(sizes[s] / weights[s] for s in sizes)
    rate = F.coalesce(F.create_map(*[F.lit(x) for s in sizes for x in (s, float(scale * weights[s] / sizes[s]))])[F.col("source")], F.lit(0.0))
    return docs.where(F.pmod(F.xxhash64(F.lit(seed), order_col), F.lit(1 << 30)) < rate * (1 << 30))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("text")


def sample_documents(spark: SparkSession) -> DataFrame:
    """Nine documents that exercise the pipeline: prose with a near and an exact copy, code, junk of four kinds."""
    river = "The river rises in the hills behind the old mill and runs slowly through three villages before it meets the sea. In spring the water is high and brown, and the ferry stays tied to its post for days. People who live beside it know the sound it makes when rain has fallen far inland, and they move their boats before anyone has to tell them."
    garden = "A kitchen garden wants little more than good soil, some shade at noon and a person who looks at it every day. Beans climb whatever they are given, lettuce runs to seed in the first heat, and tomatoes repay a string and a stake with more fruit than one household can eat. Whoever plants mint learns to plant it in a pot."
    code = "\n".join(f"def area_{i}(width, height):\n    total = width * height + {i}\n    return total\n" for i in range(6))
    rows = [("prose", river), ("prose", river.replace("for days", "for many days")), ("prose", river), ("prose", garden), ("code", code), ("junk", "too brief"), ("junk", "#" * 600), ("junk", "red fish " * 80), ("junk", "a b c d e f g h " * 30)]
    data = [(i, x, f"sample-{s}", "code" if s == "code" else "prose", i) for i, (s, x) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def read_text_file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """A clean corpus written by ``writers.write_clean``; a missing kind is prose."""
    return spark.read.parquet(path).withColumn("kind", F.coalesce("kind", F.lit("prose")))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text, source, kind`` lines, plain or compressed with a codec that Spark reads."""
    return spark.read.schema("text string, source string, kind string").json(path).withColumn("kind", F.coalesce("kind", F.lit("prose")))


def read_json_lines_zstd(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """The same from .zst files, each streamed through a decompressor in its task; a last line without an end is dropped."""
    import io
    import json

    import pandas as pd

    def lines(batches):
        import zstandard

        for pdf in batches:
            for content in pdf["content"]:
                reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(content)), read_across_frames=True)
                rest = b""
                while data := reader.read(chunk):
                    *whole, rest = (rest + data).split(b"\n")
                    rows = [json.loads(x) for x in whole if x.strip()]
                    yield pd.DataFrame({k: [r.get(k) for r in rows] for k in ("text", "source", "kind")})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(lines, "text string, source string, kind string").withColumn("kind", F.coalesce("kind", F.lit("prose")))
