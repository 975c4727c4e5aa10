"""Readers that check what they read, and writers of segments, manifests, exports and reports."""

from __future__ import annotations

import io
import posixpath
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.operators.joins import must, unique

OOD_NAMES = ["segment_ood", "is_ood", "ood"]


def scan(spark: SparkSession, path: str, schema: str, required: list[str] = (), key: list[str] = (), checks: dict[str, Column] | None = None) -> DataFrame:
    """Rows of the JSON lines under a path, files in any depth. Rows that lack a required column are not of this kind and are
    skipped; a repeated key raises, and so does a row that fails a check (a name and a condition)."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    for what, good in (checks or {}).items():
        rows = must(rows, good, what, list(key or required))
    return unique(rows, list(key), "key") if key else rows


def aliased(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """rows with each name from the first of its aliases that the table has and that isn't null."""
    for name, aliases in names.items():
        held = [F.col(a) for a in aliases if a in rows.columns]
        if not held:
            raise ValueError(f"none of {aliases} is there")
        rows = rows.withColumn(name, F.coalesce(*held))
    return rows


def ood_flags(rows: DataFrame) -> DataFrame:
    """rows with `ood`, from whichever of its names is there; null and none count as false."""
    held = [F.col(n).cast("boolean") for n in OOD_NAMES if n in rows.columns]
    return rows.withColumn("ood", F.coalesce(*held, F.lit(False)))


def manifests(spark: SparkSession, pattern: str, schema: str, campaign: str) -> DataFrame:
    """Manifests of a campaign among the JSON files of a glob pattern, with the file of each."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.input_file_name()).where(F.col("campaign_id") == campaign)


def scroll(points: DataFrame, sample_id: str | int, **equal) -> DataFrame:
    """Points of one sample that equal the other values too. The sample is not optional, so that none sees another's."""
    if sample_id is None:
        raise ValueError("a search needs a sample")
    kept = points.where(F.col("sample_id") == sample_id)
    for name, value in equal.items():
        kept = kept.where(F.col(name).eqNullSafe(value))
    return kept


def _cells(archive: zipfile.ZipFile, sheet: str) -> list[dict[int, str | None]]:
    """A worksheet's rows: text by column number."""
    local = lambda node: node.tag.rpartition("}")[2]
    tree = lambda name: ET.fromstring(archive.read(name))
    text = lambda node: "".join(x.text or "" for x in node.iter() if local(x) == "t")
    names = set(archive.namelist())
    shared = [text(x) for x in tree("xl/sharedStrings.xml") if local(x) == "si"] if "xl/sharedStrings.xml" in names else []
    link = [v for x in tree("xl/workbook.xml").iter() if local(x) == "sheet" and x.get("name") == sheet for k, v in x.attrib.items() if k.endswith("}id")]
    if not link:
        raise ValueError(f"no worksheet {sheet}")
    target = next(x.get("Target") for x in tree("xl/_rels/workbook.xml.rels") if x.get("Id") == link[0])
    rows = []
    for row in (x for x in tree(posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")).iter() if local(x) == "row"):
        cells = {}
        for c in (x for x in row if local(x) == "c"):
            column = 0
            for letter in re.match("[A-Z]*", c.get("r", "")).group():
                column = column * 26 + ord(letter) - 64
            raw, kind = next((x.text for x in c if local(x) == "v"), None), c.get("t", "n")
            if kind == "inlineStr":
                raw = text(c)
            elif raw is not None and kind == "s":
                raw = shared[int(raw)]
            elif raw is not None and kind == "b":
                raw = "true" if raw == "1" else "false"
            cells[column] = raw
        rows.append(cells)
    return rows


def worksheet(spark: SparkSession, path: str, sheet: str, columns: list[str]) -> DataFrame:
    """Rows of a named worksheet in the workbooks of a path: a string for each column of the header row that is asked for, null
    where a row lacks it; cast as needed. A workbook is read by one task; blank rows are skipped, a missing column raises."""

    def parse(frames):
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame.path, frame.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    head, *rows = _cells(archive, sheet) or [{}]
                at = {v.strip(): k for k, v in head.items() if v}
                lacking = [c for c in columns if c not in at]
                if lacking:
                    raise ValueError(f"{name} lacks {lacking}")
                kept = [[r.get(at[c]) for c in columns] for r in rows if any(v not in (None, "") for v in r.values())]
                yield pd.DataFrame(kept, columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def write_segments(segments: DataFrame, path: str, facts: dict[str, str]) -> DataFrame:
    """Writes segments, a folder a sample, and a manifest of their count and the given facts; returns the manifest as read."""
    spark = segments.sparkSession
    segments.repartition("sample_id").write.mode("overwrite").partitionBy("sample_id").parquet(f"{path}/segments")
    made = spark.read.parquet(f"{path}/segments").agg(F.count("*").alias("segments"), F.count_distinct("sample_id").alias("samples"))
    write_manifest(made.select("*", *[F.lit(v).alias(k) for k, v in facts.items()]), f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def write_manifest(row: DataFrame, path: str) -> None:
    """One row as JSON, its keys sorted. The committer makes it visible as a whole."""
    row.select(*sorted(row.columns)).coalesce(1).write.mode("overwrite").json(path)


def without_assembly(points: DataFrame, assembly: str) -> DataFrame:
    """The store without an assembly's points; points of no assembly stay."""
    return points.where(~F.col("assembly_id").eqNullSafe(assembly))


def store_assembly(routes: DataFrame, points: DataFrame, path: str, key: str) -> DataFrame:
    """Writes an assembly's points under path, reads them back, and returns its ledger: the routes with status and point_count.

    points: of `joins.stamped`. `ready`: as many points as the assembly has are there, and each segment's are of the tier that it
    is routed to. `failed`: otherwise, and then the points are deleted again. A segment may have no points.
    """
    spark = points.sparkSession
    points.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    tiers = stored.groupBy(key).agg(F.count("*").alias("n"), F.min("source_collection_tier").alias("low"), F.max("source_collection_tier").alias("high"))
    fits = (F.col("low") == F.col("tier")) & (F.col("high") == F.col("tier"))
    n, bad = tiers.join(routes.select(key, "tier"), key, "left").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(~F.coalesce(fits, F.lit(False)))).first()
    ready = n == points.count() and not bad
    if not ready:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return routes.withColumns({"status": F.lit("ready" if ready else "failed"), "point_count": F.lit(n).cast("long")})


def upserted(store: DataFrame, facts: DataFrame, tier: str, key: str = "fact_id", frozen: bool = False) -> DataFrame:
    """A tier's store with facts in it, in place of those of the same key. A fact of another tier raises, as do a frozen store and a repeated key."""
    if frozen:
        raise ValueError("the candidates are frozen")
    new = unique(must(facts, F.col("memory_tier") == tier, "a fact of another tier", [key]), [key], "fact")
    return store.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def export(points: DataFrame, scope: list[str], payload: list[str], order: str) -> DataFrame:
    """(scope, n, points): a scope's points as one JSON text, in order. A scope is a sample's tier, so it is small."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*payload).alias("p"))))
    return points.groupBy(*scope).agg(F.count("*").alias("n"), F.to_json(F.transform(each, lambda x: x["p"])).alias("points"))


def report(df: DataFrame, title: str, rows: int) -> str:
    """A Markdown table of the first rows of a sorted, aggregated table: a report for people, with as many rows as asked for."""
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *map(line, df.limit(rows).collect())]) + "\n"


def sqlite_ledger(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """Rows of a SQLite ledger's file or files: sequence and the fields of row_json, read in memory and never written.

    A file is one task's; a name that is no identifier, or a missing table, raises. Larger ledgers belong in Parquet.
    """
    if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", table):
        raise ValueError(f"not a table's name: {table!r}")

    def read(batches):
        for pdf in batches:
            for content in pdf["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                if not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone():
                    raise ValueError(f"no table {table}")
                yield pd.DataFrame(con.execute(f'SELECT sequence, row_json FROM "{table}" ORDER BY sequence').fetchall(), columns=["sequence", "row_json"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "sequence long, row_json string")
    return rows.select("sequence", F.from_json("row_json", schema).alias("r")).select("sequence", "r.*")


#: Columns of a point that searches filter by; the first three are the store's folders, in this order.
PAYLOAD = ["dataset_name", "split", "memory_tier", "sample_id", "session_id", "segment_id", "model_id", "model_family", "campaign_id", "extraction_run_id", "batch_id", "assembly_id", "policy_version"]


def write_points(points: DataFrame, path: str, size: int) -> None:
    """Points as a store: folders by dataset, split and tier, sorted by sample within files, so that filters skip files and row groups.

    Columns of PAYLOAD that are missing become null. A vector of another length than size raises.
    """
    full = points.withColumns({c: F.lit(None).cast("string") for c in PAYLOAD if c not in points.columns})
    checked = full.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"a vector's length is not {size}: "), F.size("vector").cast("string")))))
    by = PAYLOAD[:3]
    checked.repartition(*by, F.pmod(F.xxhash64("sample_id"), F.lit(64))).sortWithinPartitions(*by, "sample_id", "segment_id").write.mode("overwrite").partitionBy(*by).parquet(path)


def from_payload(rows: DataFrame, payload: str, fields: dict[str, str], required: list[str]) -> DataFrame:
    """rows with a fact payload (JSON object) as columns: fields (name to type), and `extra`, a map of all other keys.

    segment_hash may be named source_content_hash. A required field that is missing raises.
    """
    whole = F.from_json(payload, "map<string,string>")
    own = F.from_json(payload, ", ".join(f"{n} {t}" for n, t in fields.items()))
    hashed = F.coalesce(F.try_element_at(whole, F.lit("segment_hash")), F.try_element_at(whole, F.lit("source_content_hash")))
    made = {n: hashed.cast(t) if n == "segment_hash" else own[n] for n, t in fields.items()}
    lacking = F.filter(F.array(*[F.when(made[n].isNull(), n) for n in required]).cast("array<string>"), lambda x: x.isNotNull())
    kept = rows.withColumn("__lacks", lacking)
    extra = F.map_filter(whole, lambda k, _: ~k.isin([*fields, "schema_version", "source_content_hash"]))
    sure = F.when(F.size("__lacks") == 0, extra).otherwise(F.raise_error(F.concat(F.lit("a fact payload lacks "), F.array_join("__lacks", ", "))))
    return kept.select(*[c.alias(n) for n, c in made.items()], sure.alias("extra"))


def to_payload(facts: DataFrame, version: str) -> Column:
    """A fact row as its payload: JSON with the schema's version, the source's hash under its stored name, and extra keys beside the others.

    Keys come in the order of the columns, extra ones last.
    """
    names = {"segment_hash": "source_content_hash"}
    own = F.to_json(F.struct(*[F.col(c).alias(names.get(c, c)) for c in facts.columns if c != "extra"], F.lit(version).alias("schema_version")))
    extra = F.to_json(F.coalesce("extra", F.create_map().cast("map<string,string>"))) if "extra" in facts.columns else F.lit("{}")
    return F.when(extra == "{}", own).otherwise(F.concat(F.left(own, F.length(own) - 1), F.lit(","), F.substring(extra, 2, 1 << 30)))


def segments_of(spark: SparkSession, root: str, schema: str, sample_ids: list[str] | None = None) -> DataFrame:
    """Segments under `root/samples/<sample>/segments.jsonl`, of the given samples or all. A given sample without a file raises.

    A sample's folder must hold its own segments only: a row of another sample_id raises.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/samples/*/segments.jsonl")
    found = {f.getPath().getParent().getName(): f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)}
    lacking = sorted(set(sample_ids or ()) - set(found))
    if lacking or not found:
        raise ValueError(f"no segments of {lacking[:8] or root}")
    rows = spark.read.schema(schema).json([found[s] for s in (found if sample_ids is None else dict.fromkeys(sample_ids))])
    home = F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -2)
    return must(rows.withColumn("__home", home), F.col("sample_id") == F.col("__home"), "a segment of another sample", ["sample_id", "__home"]).drop("__home")
