"""Readers of the engine's file formats, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fraction

MOTION = "video_id string, frame_idx int, t double, raw_diff double, raw_bg double, raw_flow double, norm_diff double, norm_bg double, norm_flow double, score double, jerk_score double"
QUALITY = "video_id string, frame_idx int, t double, shake_magnitude double, blur_score double, brightness double, brightness_jump double, possible_camera_motion int, q_observability double"
LEDGER = "seq int, kind string, subject string, job_id string, actor_id string, timestamp string, payload_hash string, statement_hash string, prev_hash string, entry_hash string, signature string"
EVENT = "video_id string, event_id int, event_type string, start double, end double, status string, offences array<struct<type:string,track_id:string,frame_idx:int,start_sec:double,end_sec:double,confidence:double,bbox:array<int>,suppressed:boolean>>"
CONTAINERS = ("mp4", "avi", "mov", "mkv", "webm")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; columns are matched by name and missing ones are null.

    ``_unreadable`` names the columns whose text is there but is no value of their type, null if there are none.
    """
    found = spark.read.option("header", True).csv(path)
    wanted = [x.strip().split(" ") for x in schema.split(",")]
    values = {n: F.col(n).try_cast(t) if n in found.columns else F.lit(None).cast(t) for n, t in wanted}
    bad = F.array_compact(F.array(*[F.when(F.col(n).isNotNull() & values[n].isNull(), F.lit(n)) for n, _ in wanted if n in found.columns], F.lit(None).cast("string")))
    return found.select(*[v.alias(n) for n, v in values.items()], F.when(F.size(bad) > 0, bad).alias("_unreadable"))


def motion(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, MOTION)


def quality(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, QUALITY)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A log of one JSON document a line; blank lines are left out.

    A damaged line is kept with its text in ``_damaged``, as a log that hides it would hide tampering.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", LEDGER + ", _damaged string", {"columnNameOfCorruptRecord": "_damaged"}).alias("e")).select("value", "e.*")
    return parsed.withColumn("_damaged", F.coalesce("_damaged", F.when(F.col("seq").isNull(), F.col("value")))).drop("value")


def chain(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """A log from a Parquet table in order of its numbers, of one job if asked for."""
    log = spark.read.parquet(path)
    return (log if job_id is None else log.where(F.col("job_id") == job_id)).orderBy("seq")


def keyed(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """(key, fields): the entries of a JSON document that maps keys to structs; none if there is no document."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, {fields}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{fields.replace(' ', ':').replace(',:', ',')}>>")).alias("key", "v")).select("key", "v.*")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def active_job(spark: SparkSession, path: str, default: str) -> str:
    """The job that a pointer file names; the default if there is none or it is blank."""
    if not exists(spark, path):
        return default
    row = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.jobId").alias("job")).first()
    return (row and row["job"] or "").strip() or default


def checked_job(name: str) -> str:
    """A job's name that may become part of a path; raises ValueError for one that leaves its folder."""
    if not name.strip() or ".." in name or "/" in name or "\\" in name:
        raise ValueError(f"invalid job {name!r}")
    return name


def event_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Events of all jobs that a path pattern matches, with the job's folder as ``job_id``."""
    found = spark.read.schema(EVENT).option("multiLine", True).json(pattern)
    return found.withColumn("job_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events of the jobs whose documents are lines of a few files, each {"job_id": .., "events": [..]}."""
    found = spark.read.schema(f"job_id string, events array<struct<{EVENT}>>").json(path)
    return found.select(F.inline("events"), "job_id")


def findings(events: DataFrame, with_suppressed: bool = False) -> DataFrame:
    """One row per finding of each event; suppressed ones only if asked for."""
    rows = events.select("job_id", "event_id", F.inline("offences"))
    return rows if with_suppressed else rows.where(~F.coalesce("suppressed", F.lit(False)))


def frame_of(path: Column) -> Column:
    """The frame number in ``..__f0000123__t...``; null for other names."""
    return F.nullif(F.regexp_extract(path, r"__f(\d{7})__", 1), F.lit("")).cast("int")


def mask_frame_of(path: Column) -> Column:
    """The frame number after the last ``_f`` of a mask's name; null if that is no number."""
    return F.element_at(F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "_f"), -1).try_cast("int")


def region_anomalies(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx, region, z) of a job's baselines file, a row for each anomaly, to be joined by frame.

    The stage that writes it can be skipped, so a file that is missing or isn't JSON, or a grid without two sides of at least one
    cell, gives no rows.
    """
    schema = "grid array<int>, anomalies array<struct<frame_idx:bigint,region:string,z:double>>"
    if not exists(spark, path):
        return spark.createDataFrame([], "frame_idx bigint, region string, z double")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("f")).select("f.*")
    usable = (F.size("grid") == 2) & (F.get("grid", F.lit(0)) >= 1) & (F.get("grid", F.lit(1)) >= 1)
    return whole.where(usable).select(F.inline("anomalies")).where("frame_idx is not null")


def stills(paths: DataFrame) -> DataFrame:
    """(path, kind, video, event_id, frame_idx) of a listing of stills, by their names.

    ``event3_f0000012.jpg`` is a snapshot of an event, ``annotated_frame_0000012.jpg`` an annotated frame and ``cam__f0000012__t1.5.jpg`` a
    sampled frame of a video; other names are left out.
    """
    name = F.element_at(F.split("path", "/"), -1)
    patterns = {"snapshot": r"^event(\d+)_f(\d{7})\.jpg$", "annotated": r"^annotated_frame_()(\d{7})\.jpg$", "sampled": r"^(.+)__f(\d{7})__t[^/]*\.jpg$"}
    kind = F.coalesce(*[F.when(name.rlike(p), F.lit(k)) for k, p in patterns.items()])
    part = lambda i: F.coalesce(*[F.when(name.rlike(p), F.regexp_extract(name, p, i)) for p in patterns.values()])
    found = paths.select("path", kind.alias("kind"), part(1).alias("_whose"), part(2).cast("bigint").alias("frame_idx")).where("kind is not null")
    return found.select("path", "kind", F.when(F.col("kind") == "sampled", F.col("_whose")).alias("video"), F.when(F.col("kind") == "snapshot", F.col("_whose").cast("bigint")).alias("event_id"), "frame_idx")


def listed_stills(spark: SparkSession, folder: str) -> DataFrame:
    """``stills`` of a folder and those below it; only their names are read."""
    return stills(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, frame_idx) of the stills in a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", frame_of(F.col("path")).alias("frame_idx")).where(F.col("frame_idx").isNotNull())


def probed(documents: DataFrame, column: str = "probe") -> DataFrame:
    """Frame rate, duration and frame count from a media probe's JSON; the first video stream counts.

    The count is the stream's, else rate times duration; 0 counts as missing.
    """
    kind = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,nb_frames:string,duration:string>>,format:struct<duration:string>>"
    d = documents.withColumn("_p", F.from_json(column, kind))
    video = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    fps = F.nullif(fraction(video["r_frame_rate"]), F.lit(0.0))
    seconds = F.coalesce(F.nullif(video["duration"].try_cast("double"), F.lit(0.0)), F.nullif(F.col("_p.format.duration").try_cast("double"), F.lit(0.0)))
    frames = F.coalesce(F.nullif(video["nb_frames"].try_cast("bigint"), F.lit(0)), F.round(fps * seconds).cast("bigint"))
    # the stream's own count and duration win; what they contradict by more than a frame is told
    guess = F.round(fps * F.nullif(F.col("_p.format.duration").try_cast("double"), F.lit(0.0))).cast("bigint")
    warning = F.when(F.abs(frames - guess) > 1, F.format_string("stream has %d frames, the container's duration gives %d", frames, guess))
    return d.withColumns({"warning": warning, "codec": video["codec_name"], "width": video["width"], "height": video["height"], "fps": fps, "duration_sec": seconds, "frame_count": frames}).drop("_p")


def sampled_frames(videos: DataFrame, target_fps: float = 5.0) -> DataFrame:
    """(video_id, frame_idx, t): every stride-th frame, never more than the video has."""
    stride = F.greatest(F.lit(1), F.bround(F.col("fps") / F.least(F.lit(target_fps), F.col("fps"))).cast("int"))
    rows = videos.where("frame_count > 0").withColumn("stride", stride)
    return rows.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frame_count") - 1, F.col("stride").cast("bigint"))).alias("frame_idx"), "fps").select("video_id", "frame_idx", F.round(F.col("frame_idx") / F.col("fps"), 4).alias("t"))


def uploads(files: DataFrame, most_bytes: int = 2 << 30) -> DataFrame:
    """Files with whether they are accepted, and why not."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~ext.isin(*CONTAINERS), "container").when(F.col("length") > most_bytes, "size")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
