"""Reading conversation records and writing them as tables of samples, sessions, turns and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Keys under which a file may hold its list of records, first one first.
WRAPPERS = ["data", "records", "examples", "items"]


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file or folder. `.jsonl`: an object a line, blank lines and non-objects skipped; else whole JSON files: a
    list, an object that wraps a list under one of WRAPPERS, or one record."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if path.endswith(".jsonl"):
        lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.ltrim("value").startswith("{"))
        return lines.select(F.from_json("value", kind).alias("r")).select("r.*")
    wrapped = T.StructType([*kind.fields, *[T.StructField(w, T.ArrayType(kind)) for w in WRAPPERS]])
    files = spark.read.schema(wrapped).option("multiLine", True).json(path)
    own = F.array(F.struct(*[F.col(f.name) for f in kind.fields]))
    return files.select(F.explode(F.coalesce(*WRAPPERS, own)).alias("r")).select("r.*")


def parse_time(raw: Column) -> tuple[Column, Column]:
    """(ISO time, weekday) of `1:56 pm on 8 May, 2023` or `2023/05/20 (Sat) 02:21`; the raw text and null where neither fits."""
    plain = F.regexp_replace(raw, r" \(\w+\)", "")
    at = F.coalesce(F.try_to_timestamp(plain, F.lit("h:mm a 'on' d MMMM, yyyy")), F.try_to_timestamp(F.upper(plain), F.lit("h:mm a 'ON' d MMMM, yyyy")), F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), raw), F.date_format(at, "EEE")


def split_of(path: Column) -> Column:
    """train, dev, val or test from a file's name; valid and validation are val; null without any."""
    word = F.regexp_extract(F.lower(F.element_at(F.split(path, "/"), -1)), r"(?:^|[^a-z])(train|dev|validation|valid|val|test)(?:[^a-z]|$)", 1)
    return F.when(word == "", F.lit(None)).when(word.isin("valid", "validation"), "val").otherwise(word)


def with_running_ids(turns: DataFrame) -> DataFrame:
    """turns (sample_id, session_no, offset, ...) and turn_id: 1 onwards through a sample's sessions."""
    return turns.withColumn("turn_id", F.row_number().over(W.partitionBy("sample_id").orderBy("session_no", "offset")))


def locomo_turns(records: DataFrame) -> DataFrame:
    """Turns of records (sample_id, conversation: JSON object of session_<n> lists and session_<n>_date_time texts).

    Sessions are those keys that hold a list, in the order of their numbers; a caption is appended to its text once.
    """
    parsed = records.select("sample_id", F.from_json("conversation", "map<string,string>").alias("m"))
    s = parsed.select("sample_id", "m", F.explode(F.map_filter("m", lambda k, v: k.rlike(r"^session_\d+$") & v.startswith("["))).alias("key", "value"))
    s = s.select("sample_id", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session_no"), F.element_at("m", F.concat("key", F.lit("_date_time"))).alias("raw_time"), F.from_json("value", "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>").alias("turns"))
    time, weekday = parse_time(F.col("raw_time"))
    t = s.select("sample_id", "session_no", time.alias("session_time"), weekday.alias("weekday"), F.posexplode("turns").alias("offset", "t"))
    caption = F.concat(F.lit(" (image description: "), F.col("t.blip_caption"), F.lit(")"))
    text = F.coalesce("t.text", F.lit(""))
    text = F.when(F.col("t.blip_caption").isNull() | F.contains(text, caption), text).otherwise(F.concat(text, caption))
    return with_running_ids(t.select("sample_id", "session_no", "session_time", "weekday", "offset", F.coalesce("t.speaker", F.lit("unknown")).alias("role"), "t.dia_id", text.alias("text")))


def longmemeval_turns(records: DataFrame) -> DataFrame:
    """Turns of records (question_id, haystack_session_ids, haystack_dates, haystack_sessions)."""
    z = records.select(F.col("question_id").alias("sample_id"), F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_no", "s"))
    time, weekday = parse_time(F.col("s.haystack_dates"))
    t = z.select("sample_id", "session_no", F.col("s.haystack_session_ids").alias("session_id"), time.alias("session_time"), weekday.alias("weekday"), F.posexplode("s.haystack_sessions").alias("offset", "t"))
    return with_running_ids(t.select("sample_id", "session_no", "session_id", "session_time", "weekday", "offset", F.coalesce("t.role", F.lit("unknown")).alias("role"), F.coalesce("t.content", F.lit("")).alias("text")))


def questions(records: DataFrame) -> DataFrame:
    """question_id, type, judge profile and whether it can't be answered (an id that holds `abs`)."""
    kind = F.col("question_type")
    profile = F.when(F.contains("question_id", F.lit("abs")), "abstention").when(kind == "temporal-reasoning", "temporal").when(kind == "knowledge-update", "update").when(kind == "single-session-preference", "preference").otherwise("default")
    return records.select("question_id", "question_type", profile.alias("judge_profile"), F.contains("question_id", F.lit("abs")).alias("is_unanswerable"))


def chat_text(response: Column) -> Column:
    """The text of a chat response: of one JSON body, or of `data:` lines, put together."""
    lines = F.filter(F.transform(F.split(response, r"\r?\n"), F.trim), lambda x: x.startswith("data:") & ~x.contains("[DONE]"))
    parts = F.transform(lines, lambda x: F.coalesce(F.get_json_object(F.substring(x, 6, 1 << 30), "$.choices[0].delta.content"), F.lit("")))
    return F.when(F.size(lines) > 0, F.array_join(parts, "")).otherwise(F.get_json_object(response, "$.choices[0].message.content"))


def write_tables(turns: DataFrame, path: str) -> DataFrame:
    """Writes turns, sessions and samples as Parquet under path, and returns the counts as one row."""
    sessions = turns.groupBy("sample_id", "session_no").agg(F.count("*").alias("n_turns"))
    samples = sessions.groupBy("sample_id").agg(F.count("*").alias("n_sessions"), F.sum("n_turns").alias("n_turns"))
    turns.write.mode("overwrite").parquet(f"{path}/turns")
    sessions.write.mode("overwrite").parquet(f"{path}/sessions")
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    return turns.sparkSession.read.parquet(f"{path}/samples").agg(F.count("*").alias("samples"), F.sum("n_sessions").alias("sessions"), F.sum("n_turns").alias("turns"))


def write_split(turns: DataFrame, questions: DataFrame, path: str, dataset: str, split: str, raw_files: list[str] | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Writes a split's four tables and a manifest, whose row is returned as read: names, counts, files and digests of the raw files.

    A raw file is hashed by one task as a whole. Questions are a table of `questions_of`.
    """
    spark = turns.sparkSession
    counts = write_tables(turns, path)
    questions.write.mode("overwrite").parquet(f"{path}/questions")
    n_questions = spark.read.parquet(f"{path}/questions").agg(F.count("*").alias("n"))
    if raw_files:
        raw = spark.read.format("binaryFile").load(raw_files).select(F.struct("path", F.sha2("content", 256).alias("sha256")).alias("f")).agg(F.array_sort(F.collect_list("f")).alias("files"))
    else:
        raw = spark.range(1).select(F.array().cast("array<struct<path: string, sha256: string>>").alias("files"))
    files = F.struct(*[F.lit(f"{path}/{t}").alias(t) for t in ("samples", "questions", "sessions", "turns")])
    row = counts.crossJoin(F.broadcast(n_questions)).crossJoin(F.broadcast(raw)).select(
        F.lit(dataset).alias("dataset_name"), F.lit(split).alias("split"), F.lit(3).alias("layout_version"), F.col("samples").alias("num_samples"), F.col("n").alias("num_questions"),
        F.col("sessions").alias("num_sessions"), F.col("turns").alias("num_turns"), F.col("files").alias("source_file_hashes"), files.alias("tables"),
        *([F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]).alias("metadata")] if metadata else []),
    )
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that begins with a byte order mark; nested columns as JSON."""
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema])
    flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0]).write.mode("overwrite").option("header", True).csv(path)


def questions_of(records: DataFrame, prefix: str, items: str, profile: str = "generic") -> DataFrame:
    """Questions of records (prefix: id column; items: JSON array of objects or texts), a row each, in order.

    Ids are `<prefix>_q001` onwards. A field is the first of its names that is not empty. Evidence keeps numbers as turn ids
    and everything as references. An own id that ends in `_abs` can't be answered. Broken JSON and null give no rows.
    """
    each = records.select(F.col(prefix).alias("sample_id"), F.posexplode(F.from_json(items, "array<string>")).alias("k", "item"))
    raw = F.col("item")
    is_object = F.startswith(F.ltrim(raw), F.lit("{"))
    field = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(raw, f"$.{n}"), F.lit("")) for n in names], F.lit(""))
    listed = lambda *names: F.coalesce(*[F.from_json(F.nullif(F.get_json_object(raw, f"$.{n}"), F.lit("[]")), "array<string>") for n in names], F.array().cast("array<string>"))
    numbers = F.transform(F.filter(listed("evidence_turn_ids", "supporting_turn_ids"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))
    return each.select(
        "sample_id", F.format_string("%s_q%03d", F.col("sample_id").cast("string"), F.col("k") + 1).alias("question_id"),
        F.when(is_object, field("question", "query", "prompt")).otherwise(raw).alias("question"), field("answer", "gold_answer", "target").alias("answer"),
        field("question_type").alias("question_type"), field("category").alias("category"), F.nullif(field("question_date"), F.lit("")).alias("question_date"),
        numbers.alias("evidence_turn_ids"), listed("evidence", "supporting_turn_refs").alias("evidence_turn_refs"), listed("answer_session_ids", "evidence_session_ids").alias("evidence_session_ids"),
        F.coalesce(F.nullif(field("judge_profile"), F.lit("")), F.lit(profile)).alias("judge_profile"), ((field("is_unanswerable") == "true") | F.endswith(field("question_id"), F.lit("_abs"))).alias("is_unanswerable"),
    )


def flattened(samples: DataFrame) -> DataFrame:
    """A row for each turn of samples (sample_id, sessions: array of (session_id, turns: array of struct)), with the turns' own columns."""
    sessions = samples.select("sample_id", F.explode("sessions").alias("s"))
    return sessions.select("sample_id", "s.session_id", F.explode("s.turns").alias("t")).select("sample_id", "session_id", "t.*")


def splits(spark: SparkSession, root: str) -> list[str]:
    """Names of the splits under a folder, sorted; none if it is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(path) if f.isDirectory()) if files.exists(path) else []


def load_split(spark: SparkSession, root: str, split: str, table: str, schema: str, sample_ids: list | None = None) -> DataFrame:
    """A table (samples, questions, sessions or turns) of a split whose manifest names its file; rows of sample_ids only, if given."""
    manifest = spark.read.option("wholetext", True).text(f"{root}/{split}/manifest.json").select(F.get_json_object("value", f"$.files.{table}").alias("f")).first()
    if manifest is None or manifest["f"] is None:
        raise ValueError(f"the manifest of {split} names no {table}")
    path = manifest["f"] if "://" in manifest["f"] or manifest["f"].startswith("/") else f"{root}/{split}/{manifest['f']}"
    rows = spark.read.schema(schema).json(path)
    return rows if sample_ids is None else rows.where(F.col("sample_id").isin(sample_ids))
