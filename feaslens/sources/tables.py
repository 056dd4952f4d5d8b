"""Table and file sources and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feaslens.functions.columns import num_or

# Source tokens of a path, auxiliary file endings, difficulty bonuses.
COUNTRY_TOKENS = ("deu", "usa", "zam", "chn", "rus", "esp", "fra", "ita", "gbr")
ROAD_TOKENS = ("intersection", "highway", "freeway", "merging", "merge", "ramp", "urban", "city", "crossing", "handcrafted", "lanechange", "us101", "i80")
AUX_ENDINGS = (".net.xml", ".rou.xml", ".add.xml", ".poly.xml", ".sumocfg")
BONUSES = ((("intersection", "urban", "crossing", "city"), 10.0), (("merging", "merge", "ramp"), 8.0), (("highway", "freeway", "us101", "i80"), 6.0),
           (("obstacle", "blocked", "critical", "dangerous"), 10.0))

POINT = "array<double>"
SAMPLE_SCHEMA = f"""sample_id string, scenario_id string, commonroad_scenario_id string, ego_index int, agent_count int, agent_ids array<string>, agent_types array<string>,
times_s array<double>, current_xy array<{POINT}>, current_vel_xy array<{POINT}>, current_heading array<double>, current_size_lw array<{POINT}>,
future_xy array<array<{POINT}>>, future_vel_xy array<array<{POINT}>>, future_heading array<array<double>>, future_valid array<array<boolean>>,
map_lane_centerlines array<array<{POINT}>>, _corrupt string"""


def read_table(spark: SparkSession, path: str, schema: str | None = None, required: bool = True, fallback: str | None = None) -> DataFrame | None:
    """Parquet, CSV or JSON by suffix. A missing required table raises with its path; ``fallback`` is tried first."""
    for p in filter(None, (path, fallback)):
        reader = spark.read if schema is None else spark.read.schema(schema)
        try:
            if p.endswith((".csv", ".csv.gz")):
                return reader.option("header", True).csv(p)
            return reader.json(p) if p.endswith((".json", ".json.gz", ".jsonl")) else reader.parquet(p)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
    if required:
        raise FileNotFoundError(f"required table not found: {path}")
    return None


def flatten_samples(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Wide sample rows to (agents, states, lanes, errors). Rows that do not parse or lack arrays go to ``errors`` with a status."""
    bad = F.when(F.col("_corrupt").isNotNull(), "failed: not valid json").when(F.col("current_xy").isNull() | (F.size("current_xy") == 0), "failed: missing current_xy").when(
        F.size("current_vel_xy") != F.size("current_xy"), "failed: current_vel_xy length differs")
    marked = raw.withColumn("status", F.coalesce(bad, F.lit("ok")))
    errors = marked.filter("status != 'ok'").select("source_file", "sample_id", "status")
    ok = marked.filter("status = 'ok'")
    at = lambda c, i=None: F.get(F.col(c), F.col("agent_ix")) if i is None else F.get(F.get(F.col(c), F.col("agent_ix")), F.lit(i))
    ego = F.when(F.col("ego_index").between(0, F.size("current_xy") - 1), F.col("ego_index")).otherwise(0)
    rows = ok.select("*", ego.alias("_ego"), F.posexplode("current_xy").alias("agent_ix", "_xy"))
    scen = F.coalesce("scenario_id", "commonroad_scenario_id", "sample_id")
    head = ["sample_id", scen.alias("scenario_id"), "agent_ix", F.coalesce(at("agent_ids"), F.col("agent_ix").cast("string")).alias("agent_id"),
            F.coalesce(at("agent_types"), F.lit("unknown")).alias("agent_type"), (F.col("agent_ix") == F.col("_ego")).alias("is_ego")]
    size = [F.coalesce(at("current_size_lw", 0), F.lit(4.5)).alias("length"), F.coalesce(at("current_size_lw", 1), F.lit(1.8)).alias("width")]
    agents = rows.select(*head, F.get("_xy", F.lit(0)).alias("x"), F.get("_xy", F.lit(1)).alias("y"), at("current_vel_xy", 0).alias("vx"), at("current_vel_xy", 1).alias("vy"),
                         F.coalesce(at("current_heading"), F.lit(0.0)).alias("heading"), *size)
    zipped = F.arrays_zip(at("future_xy").alias("xy"), at("future_vel_xy").alias("v"), at("future_heading").alias("h"), at("future_valid").alias("ok"), F.col("times_s").alias("t"))
    steps = rows.select(*head[:1], head[3], head[5], *size, F.posexplode(zipped).alias("k", "s"))
    states = steps.select("sample_id", "agent_id", "is_ego", "k", F.col("s.t").alias("t_s"), F.get("s.xy", F.lit(0)).alias("x"), F.get("s.xy", F.lit(1)).alias("y"),
                          F.get("s.v", F.lit(0)).alias("vx"), F.get("s.v", F.lit(1)).alias("vy"), F.col("s.h").alias("heading"), F.coalesce("s.ok", F.lit(False)).alias("valid"), "length", "width")
    lanes = ok.select("sample_id", F.posexplode("map_lane_centerlines").alias("lane_ix", "_l")).select("sample_id", "lane_ix", F.posexplode("_l").alias("seq", "_p")).select(
        "sample_id", "lane_ix", "seq", F.get("_p", F.lit(0)).alias("x"), F.get("_p", F.lit(1)).alias("y"))
    return agents, states, lanes, errors


def read_samples_json(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Gzip or plain JSON samples, one document per file; a broken file becomes an error row, not a failure."""
    raw = spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return flatten_samples(raw.withColumn("source_file", F.input_file_name()))


def sample_paths(manifest: DataFrame, folder: str) -> DataFrame:
    """Path of every sample: the manifest's own, else ``folder/<sample_id>.json.gz``."""
    own = F.nullif(F.trim(F.col("json_gz_path")), F.lit("")) if "json_gz_path" in manifest.columns else F.lit(None).cast("string")
    return manifest.withColumn("json_path", F.coalesce(own, F.concat(F.lit(folder.rstrip("/") + "/"), F.col("sample_id"), F.lit(".json.gz"))))


def parse_scenario_xml(docs: DataFrame, path: str, text: str) -> DataFrame:
    """Counts and tags of scenario XML texts, with a status per document.

    XPath on local names works with and without namespaces. Dynamic and static obstacles are read from both file layouts (typed element or ``role``).
    A text that the XML reader can't parse to its end, or that is no scenario, is ``failed``; XPath, which would stop the job, doesn't get to see it.
    """
    raw = F.col(text)
    record = F.from_xml(raw, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = raw.rlike(r"(?s)^\s*<.*>\s*$") & raw.contains("commonRoad") & record.isNotNull() & record["_bad"].isNull()
    docs = docs.withColumn("_doc", F.when(F.coalesce(whole, F.lit(False)), raw))
    doc = F.col("_doc")
    local = lambda n: f"*[local-name()='{n}']"
    count = lambda expr: F.xpath_int(doc, F.lit(f"count({expr})"))
    dyn = f"//{local('dynamicObstacle')} | //{local('obstacle')}[{local('role')}='dynamic']"
    stat = f"//{local('staticObstacle')} | //{local('obstacle')}[{local('role')}='static']"
    good = docs.withColumn("parse_status", F.when(doc.isNotNull(), "ok").otherwise("failed"))
    when = lambda c: F.when(F.col("parse_status") == "ok", c)
    types = F.xpath(doc, F.lit(f"//{local('dynamicObstacle')}/{local('type')}/text() | //{local('staticObstacle')}/{local('type')}/text() | //{local('obstacle')}/{local('type')}/text()"))
    steps = F.xpath(doc, F.lit(f"//{local('time')}/{local('exact')}/text()"))
    tags = F.transform(F.regexp_extract_all(F.regexp_extract(doc, r"(?s)<(?:\w+:)?scenarioTags>(.*?)</(?:\w+:)?scenarioTags>", 1), F.lit(r"<(?:\w+:)?(\w+)\s*/?>"), F.lit(1)), lambda x: x)
    parsed = good.select(
        F.col(path).alias("xml_path"), "parse_status", when(F.xpath_string(doc, F.lit("string(/*/@benchmarkID)"))).alias("scenario_id"),
        when(count(f"//{local('lanelet')}[@id]")).alias("lanelet_count"), when(count(dyn)).alias("dynamic_obstacle_count"), when(count(stat)).alias("static_obstacle_count"),
        when(count(f"//{local('planningProblem')}")).alias("planning_problem_count"), when(types).alias("_types"),
        when(F.array_max(F.transform(steps, lambda s: s.try_cast("int")))).alias("max_time_step"), when(F.array_sort(F.array_distinct(tags))).alias("_tags"))
    kinds = F.array_sort(F.array_distinct("_types"))
    counted = F.transform(kinds, lambda k: F.concat_ws(":", k, F.size(F.filter("_types", lambda t: t == k)).cast("string")))
    return parsed.withColumns({"obstacle_types": F.array_join(counted, ";"), "tags": F.array_join("_tags", "|")}).drop("_types", "_tags")


def scan_xml_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Every XML file under a folder; files are split over tasks by the binary source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(root)
    texts = files.select("path", F.decode("content", "UTF-8").alias("text"))
    return parse_scenario_xml(texts, "path", "text")


def path_attributes(df: DataFrame, path: str) -> DataFrame:
    """Family from the file stem, source tokens and difficulty from the path and counts."""
    p = F.regexp_replace(F.col(path), r"\\", "/")
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]+)$", 1), r"\.[^.]*$", "")
    parent = F.regexp_extract(p, r"([^/]+)/[^/]+$", 1)
    family = F.when(stem.contains("_"), F.substring_index(stem, "_", 1)).when(stem.contains("-"), F.substring_index(stem, "-", 1)).otherwise(parent)
    low = F.lower(p)
    tokens = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t.upper())) for t in COUNTRY_TOKENS], *[F.when(low.contains(t), F.lit(t)) for t in ROAD_TOKENS]))
    bonus: Column = F.lit(0.0)
    for words, gain in BONUSES:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        bonus = bonus + F.when(hit, gain).otherwise(0.0)
    n = lambda c: num_or(df, c, 0.0) if c not in df.columns else F.coalesce(num_or(df, c), F.lit(0.0))
    difficulty = n("dynamic_obstacle_count") * 2.0 + n("lanelet_count") * 0.2 + n("planning_problem_count") * 2.0 + n("max_time_step") * 0.01 + bonus
    return df.withColumns({"scenario_family": family, "source_hint": F.when(F.size(tokens) == 0, "unknown").otherwise(F.array_join(tokens, "|")), "difficulty_score": difficulty})


def filter_manifest(df: DataFrame, min_steps: int, path: str = "xml_path", rel: str | None = None) -> DataFrame:
    """Scenario files only: parsed, not a simulator helper, with problems, lanes, moving obstacles and enough steps."""
    base = F.lower(F.regexp_extract(F.regexp_replace(F.col(path), r"\\", "/"), r"([^/]*)$", 1))
    where = F.lower(F.regexp_replace(F.col(rel or path), r"\\", "/"))
    aux = where.contains("/sumo/")
    for e in AUX_ENDINGS:
        aux = aux | base.endswith(e)
    n = lambda c: F.coalesce(num_or(df, c), F.lit(0.0))
    ok = F.lower(F.coalesce("parse_status", F.lit(""))) == "ok" if "parse_status" in df.columns else F.lit(True)
    return df.filter(ok & ~F.coalesce(aux, F.lit(False)) & (n("planning_problem_count") >= 1) & (n("lanelet_count") >= 1) & (n("dynamic_obstacle_count") >= 1) & (n("max_time_step") >= min_steps))


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def union_rows(*parts: DataFrame) -> DataFrame:
    """Rows of several tables over the union of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, cfg_hash: str | None = None, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Parquet (or CSV by suffix) with the configuration hash as a column."""
    out = df if cfg_hash is None else df.withColumn("config_hash", F.lit(cfg_hash))
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions laid out by endpoint and feature set, so readers of one comparison prune the rest."""
    write_table(df, path, mode=mode, partition_by=("endpoint", "feature_set"))


#: A fingerprint is eight sums modulo 2^32, one for each 32 bits of a row's SHA-256.
LANES = 8
LANE = 1 << 32


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row: columns in the order of their names, each value as text behind its length, nulls apart from every text."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n")) for c in sorted(df.columns)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _fingerprint_row(sums: DataFrame) -> DataFrame:
    lanes = [F.pmod(F.coalesce(F.col(f"_l{i}"), F.lit(0).cast("decimal(38,0)")), F.lit(LANE).cast("decimal(38,0)")).cast("bigint") for i in range(LANES)]
    return sums.select("columns", "row_count", F.array(*lanes).alias("lanes"), F.concat(*[F.lpad(F.lower(F.hex(x)), 8, "0") for x in lanes]).alias("hash"))


def fingerprint(df: DataFrame) -> DataFrame:
    """``columns``, ``row_count``, ``lanes`` and ``hash`` of a table's rows, whatever their order: equal for reruns that agree.

    The hash is a sum over rows, so fingerprints of row sets add and subtract (``combined``), and a table's need not be taken anew when rows come or
    go. Repeated rows count each time; an empty table has the hash 0.
    """
    lane = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
    sums = df.select(row_digest(df).alias("h")).agg(F.count("*").alias("row_count"), *[F.sum(lane(i)).alias(f"_l{i}") for i in range(LANES)])
    return _fingerprint_row(sums.withColumn("columns", F.lit(",".join(sorted(df.columns)))))


def combined(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The fingerprint of all rows of the ``added`` fingerprints without those of the ``removed`` ones, per set of columns."""
    rows = added.withColumn("_sign", F.lit(1))
    if removed is not None:
        rows = rows.unionByName(removed.withColumn("_sign", F.lit(-1)))
    lane = lambda i: F.sum(F.col("_sign") * F.col("lanes")[i].cast("decimal(20,0)"))
    return _fingerprint_row(rows.groupBy("columns").agg(F.sum(F.col("_sign") * F.col("row_count")).alias("row_count"), *[lane(i).cast("decimal(38,0)").alias(f"_l{i}") for i in range(LANES)]))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been written yet."""
    return df.join(done.select(key), key, "left_anti")


def append_pending(df: DataFrame, path: str, key: str) -> None:
    """Resume: writes only what the target lacks."""
    done = read_table(df.sparkSession, path, required=False)
    write_table(df if done is None else pending(df, done, key), path, mode="append")
