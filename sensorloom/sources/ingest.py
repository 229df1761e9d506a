"""CSV and ZIP slots to one long frame: discovery, schema inference, canonical names, participants.

Everything goes through the session's file systems: files are listed by Spark, archives are unpacked by tasks into the
shared folder, and all files with the same header are one scan. Only headers, file names and one row of counts a file
reach the driver.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.lineage import cut, folder
from sensorloom.registry import CHANNELS, HarmonizeError, modalities_of

# Names that hint at a time column, and formats tried in order.
TIME_HINTS = ("timestamp", "time", "ts", "datetime", "date_time", "recorded_at")
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "MM/dd/yyyy HH:mm[:ss]", "yyyy-MM-dd")
TOKEN, SHORT_TOKEN = re.compile(r"(participant|subject|user|person|p)[_-]?(\d+)", re.I), re.compile(r"([a-z]{1,3}\d{1,4})[_-]", re.I)
CORRUPT = "_corrupt"
#: Errors of one file that fail its slot.
CRITICAL = frozenset({"dataset_empty", "invalid_csv", "dataset_too_large", "missing_timestamp_column", "invalid_timestamp_format"})


@dataclass
class Slot:
    """One dataset's files as a frame (participant_id, dataset_id, ts, channels) with what was learned on the way."""

    frame: DataFrame
    participants: list[str]
    grouping: str
    modalities: list[str]
    confidence: float
    warnings: list[str] = field(default_factory=list)
    files: int = 0
    ambiguous: bool = False
    method: str = "rules"
    reasons: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Mapping:
    """What a ``Mapper`` answers: columns to channels, how sure it is, and why."""

    columns: dict[str, str]
    confidence: float
    reason: str = ""


#: Asked about headers that the rules do not recognise well: (column names, profiles of the numeric ones, first rows).
Mapper = Callable[[list[str], list[dict], list[dict]], Mapping]
# Below this the rules ask, what an answer needs at least, and what is shown of a table.
ASK_BELOW, LEAST_SURE, MOST_ASKED, PREVIEW = 0.85, 0.65, 40, 5


def label(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


# Names that stand for a channel, after ``label``; ``@``: one of x, y, z.
NAMES = {
    "acc_@": r"acc(el(erometer)?)?_?@|a_?@", "gyro_@": r"gyro(scope)?_?@|g_?@|w@", "mag_@": r"mag(netometer)?_?@|m_?@",
    "gps_lat": r"(gps_?)?lat(itude)?", "gps_lon": r"(gps_?)?(lon(gitude)?|lng)", "gps_alt": r"(gps_?)?alt(itude)?", "gps_speed": r"(gps_?)?speed|velocity",
    "heart_rate": r"heart_?rate|hr|pulse", "pressure": r"pressure|baro(meter)?", "light_lux": r"light|lux|illuminance", "proximity": r"proximity",
}
PATTERNS = [(to.replace("@", axis), re.compile(rule.replace("@", axis))) for to, rule in NAMES.items() for axis in ("xyz" if "@" in to else " ")]
SENSOR_LIKE = ("acc", "gyro", "mag", "gps", "heart", "hr", "pressure", "light", "prox")


def canonical(name: str) -> str | None:
    """The channel that a column's name stands for, or None."""
    x = label(name)
    return x if x in CHANNELS else next((to for to, rule in PATTERNS if rule.fullmatch(x)), None)


def mapping(columns: list[str]) -> dict[str, str]:
    """Column to channel; of two columns for one channel the first wins."""
    out: dict[str, str] = {}
    for c in columns:
        if (to := canonical(c)) and to not in out.values():
            out[c] = to
    return out


def profiles(df: DataFrame, names: list[str]) -> list[dict]:
    """column_name, mean, std (of all), min and max of the columns that hold numbers, to six digits; one pass."""
    numbers = {c: F.col(f"`{c}`").try_cast("double") for c in names}
    kinds = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    row = df.agg(*(F.round(f(x), 6).alias(f"{k}{i}") for i, x in enumerate(numbers.values()) for k, f in kinds.items())).head()
    return [{"column_name": c, **{k: row[f"{k}{i}"] for k in kinds}} for i, c in enumerate(numbers) if row[f"mean{i}"] is not None]


def preview(df: DataFrame, names: list[str], rows: int = PREVIEW) -> list[dict]:
    return [r.asDict() for r in df.select(*(F.col(f"`{c}`") for c in names)).limit(rows).collect()]


def judged(answer: Mapping, names: list[str], by_rules: float) -> tuple[dict[str, str] | None, str]:
    """The answer's mapping of known columns to known channels, or None; and why.

    Refused: one channel twice, one of the two coordinates alone, an answer that is not sure enough or no surer than the rules.
    """
    found = {c: label(answer.columns[c]) for c in names if isinstance(answer.columns.get(c), str)}
    found = {c: x for c, x in found.items() if x in CHANNELS}
    if len(set(found.values())) < len(found):
        return None, "mapping refused: a channel is named twice"
    if len({"gps_lat", "gps_lon"} & set(found.values())) == 1:
        return None, "mapping refused: latitude and longitude go together"
    if not answer.confidence >= LEAST_SURE or answer.confidence <= by_rules:
        return None, "mapping refused: not surer than the rules"
    return found, answer.reason.strip() or "mapping by the given function"


def parsed_time(c: Column) -> Column:
    """Text to a time: the known formats in order, whole numbers as nanoseconds since 1970; else null."""
    number = F.when(c.rlike(r"^\s*-?\d{9,19}\s*$"), F.timestamp_micros(F.try_divide(c.try_cast("long"), F.lit(1000)).cast("long")))
    return F.coalesce(number, *(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in TIME_FORMATS), c.try_cast("timestamp"))


@dataclass(frozen=True, order=True)
class File:
    """A CSV file: its place below the slot's root (in an archive: archive/member), where Spark reads it, and the name
    under which its rows come."""

    rel: str
    path: str
    key: str


def listed(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """path, key and rel of all files below ``root`` with an ending; no content is read. Hidden files are not listed."""
    there = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(there):
        raise HarmonizeError("no_csv_files", f"{root} does not exist")
    status = files.getFileStatus(there)
    base = status.getPath().toString() if status.isDirectory() else status.getPath().getParent().toString()
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in ending)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select("path", F.col("_metadata.file_path").alias("key"), F.substring("path", len(base.rstrip("/")) + 2, 1 << 20).alias("rel"))


def inside(member: str) -> str | None:
    """A member's place below its archive; None if it would leave it."""
    place = posixpath.normpath(member.replace("\\", "/")).lstrip("/")
    return None if place.startswith("..") or place in ("", ".") or ":" in place.split("/")[0] else place


def members_of(spark: SparkSession, root: str) -> DataFrame:
    """rel (of the archive), place (of a CSV member, null for one that would leave the archive), member, size."""
    archives = listed(spark, root, "zip").select("rel", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, data in zip(batch.column("rel").to_pylist(), batch.column("content")):
                try:
                    found = [m for m in zipfile.ZipFile(io.BytesIO(data.as_buffer())).infolist() if not m.is_dir()]
                except zipfile.BadZipFile:
                    found = []
                    yield pa.RecordBatch.from_pydict({"rel": [rel], "place": pa.array([None], pa.string()), "member": pa.array([None], pa.string())})
                if found := [m.filename for m in found if inside(m.filename) is None or m.filename.lower().endswith(".csv")]:
                    yield pa.RecordBatch.from_pydict({"rel": [rel] * len(found), "place": pa.array([inside(m) for m in found], pa.string()), "member": pa.array(found)})

    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(root)
    return archives.join(content.select("path", "content"), "path").select("rel", "content").mapInArrow(run, "rel string, place string, member string")


def unpacked(spark: SparkSession, root: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """The lines of archives' members as a stored table: no (place in ``wanted``), at, value. A task streams an archive."""
    numbers = {pair: n for n, pair in enumerate(wanted)}
    rels = listed(spark, root, "zip").select("rel", "path")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, data in zip(batch.column("rel").to_pylist(), batch.column("content")):
                if not any(r == rel for r, _ in wanted):
                    continue
                archive = zipfile.ZipFile(io.BytesIO(data.as_buffer()))
                for info in archive.infolist():
                    n = numbers.get((rel, info.filename))
                    if n is None:
                        continue
                    with archive.open(info) as raw:
                        lines, at = io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n"), 0
                        while block := [x.rstrip("\r\n") for x in lines.readlines(1 << 20)]:
                            yield pa.RecordBatch.from_pydict({"no": pa.array([n] * len(block), pa.int32()), "at": pa.array(range(at, at + len(block)), pa.int64()), "value": block})
                            at += len(block)

    return rels.join(content.select("path", "content"), "path").select("rel", "content").mapInArrow(run, "no int, at long, value string")


def find_files(root: str, most: int = 250) -> tuple[list[File], list[str]]:
    """CSV files below ``root`` and in archives there, sorted, and warnings; members that leave their archive are skipped.

    Members are unpacked by tasks into the shared folder, as one text file each. More than ``most`` files raise, before
    anything is unpacked.
    """
    spark = SparkSession.active()
    plain = listed(spark, root, "csv")
    inner = cut(members_of(spark, root), "archive-members")
    outside = inner.where("place is null")
    warnings = [f"skipped {r.member} of {r.rel}: outside its folder" if r.member else f"skipped {r.rel}: not a ZIP archive" for r in outside.orderBy("rel", "member").limit(100).collect()]
    names = inner.where("place is not null")
    n = plain.count() + names.count()
    if not n:
        raise HarmonizeError("no_csv_files", f"no CSV file below {root}")
    if n > most:
        raise HarmonizeError("too_many_files", f"{n} files, at most {most}", files=n)
    files = [File(r.rel, r.path, r.key) for r in plain.collect()]
    packed = sorted((r.rel, r.place, r.member) for r in names.collect())
    if packed:
        lines = unpacked(spark, root, [(rel, member) for rel, _, member in packed])
        # One file a member, its lines in order: what a CSV reader expects.
        placed = cut(lines, "archive-lines").repartition(F.col("no")).sortWithinPartitions("no", "at").select("no", "value")
        where = written(placed)
        empty = sorted(f"{rel}/{place}" for k, (rel, place, _) in enumerate(packed) if k not in where)
        if empty:
            raise HarmonizeError("dataset_empty", f"{empty[0]} has no columns")
        files += [File(f"{rel}/{place}", *where[k]) for k, (rel, place, _) in enumerate(packed)]
    return sorted(files), warnings


def written(rows: DataFrame) -> dict[int, tuple[str, str]]:
    """The lines (no, value) as text in the shared folder: where those of each ``no`` are, and the name of their rows."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/unpacked-{uuid4().hex}"
    rows.write.partitionBy("no").text(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("key")).collect()  # one a member
    keys = {posixpath.dirname(r.key) for r in found}
    return {int(k.rsplit("=", 1)[1]): (f"{path}/{posixpath.basename(k)}", k) for k in keys}


def participant_of(part: str) -> str | None:
    """``kind_number`` of a folder or file name that starts with one: participant-01, Participant 01 and participant01 agree."""
    found = TOKEN.match(part)
    return f"{found[1].lower()}_{found[2]}" if found else None


def group_files(files: list[File]) -> tuple[dict[File, str], str]:
    """Participant of each file: by the parts of its path, by its name alone, or one for all.

    Files without a participant are left out where others have one.
    """
    by_path = {f: t for f in files if (t := next((t for part in f.rel.split("/") if (t := participant_of(label(part)))), None))}
    if len(set(by_path.values())) >= 2:
        return by_path, "folder_based"
    by_name = {}
    for f in files:
        stem = posixpath.splitext(posixpath.basename(f.rel))[0]
        short = SHORT_TOKEN.match(stem)
        if owner := participant_of(stem) or (short and short[1].lower()):
            by_name[f] = owner
    if len(set(by_name.values())) >= 2:
        return by_name, "filename_prefix"
    return dict.fromkeys(files, "participant_01"), "single_group"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of one file as text. Empty files and broken quoting raise."""
    files = sorted(File(r.rel, r.path, r.key) for r in listed(spark, path, path.rsplit(".", 1)[-1]).collect())
    read = headers(spark, files)
    names = read[files[0]].names
    df = scan(spark, files, names)
    n, broken, _ = df.withColumn("_all", F.struct(*(F.col(f"`{c}`") for c in names))).agg(F.count(F.lit(1)), F.count(CORRUPT), F.max(F.hash("_all"))).head()
    broken += sum(h.open_quotes for h in read.values())
    if not n:
        raise HarmonizeError("dataset_empty", f"{path} has no rows")
    if broken:
        raise HarmonizeError("invalid_csv", f"{path} has {broken} malformed rows", rows=broken)
    return df.select(*(F.col(f"`{c}`") for c in names))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of any known format, by the path's ending: csv, txt (also comma-separated) or parquet."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending in ("csv", "txt"):
        return read_csv(spark, path)
    if ending == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}: csv, txt and parquet are known")


@dataclass
class Header:
    """What the first pass over a file's lines tells: the columns, and lines with an open quotation."""

    names: list[str]
    open_quotes: int


def column_names(line: str) -> list[str]:
    """The names of a header line; empty ones by place, repeated ones with their place behind them."""
    names = next(csv.reader([line]), [])
    plain = [n if n.strip() else f"_c{i}" for i, n in enumerate(names)]
    lower = [n.lower() for n in plain]
    return [n if lower.count(n.lower()) == 1 else f"{n}{i}" for i, n in enumerate(plain)]


def keyed(files: list[File]) -> Column:
    """The key of a row's file: a plain file by its own name, an unpacked one by its folder."""
    own = F.col("_metadata.file_path")
    place = F.regexp_replace(own, r"/part-[^/]*$", "")
    unpacked = [f.key for f in files if "/no=" in f.key]
    return F.when(place.isin(unpacked), place).otherwise(own) if unpacked else own


def headers(spark: SparkSession, files: list[File]) -> dict[File, Header]:
    """One pass over the lines of all files; a file without any line raises."""
    lines = spark.read.text([f.path for f in files]).select("value", keyed(files).alias("key"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"))
    # The reader closes an open quotation at the line's end without a word; such lines have an odd number of quotes.
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    found = lines.where(F.trim("value") != "").groupBy("key").agg(F.min_by("value", "at").alias("first"), F.sum((quotes % 2 == 1).cast("long")).alias("odd"))
    rows = {r.key: r for r in found.collect()}  # one a file
    out = {}
    for f in files:
        names = column_names(rows[f.key]["first"].lstrip("\ufeff")) if f.key in rows else []
        if not names:
            raise HarmonizeError("dataset_empty", f"{f.rel} has no columns")
        out[f] = Header(names, rows[f.key]["odd"])
    return out


def scan(spark: SparkSession, files: list[File], names: list[str]) -> DataFrame:
    """All rows of files with one header, as text, with their file and place: _file, _block, _id and _corrupt."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    df = spark.read.csv([f.path for f in files], header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return df.select("*", keyed(files).alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def thinned_to(df: DataFrame, steps: dict[str, int]) -> DataFrame:
    """Of each file every k-th row in file order. Rows are numbered within their blocks, blocks by running counts."""
    blocks = df.where(F.col("_file").isin(list(steps))).groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # one row a block
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = df.join(blocks.withColumn("_before", before), ["_file", "_block"], "left")
    step = F.coalesce(F.create_map(*(F.lit(x) for kv in steps.items() for x in kv))[F.col("_file")], F.lit(1))
    return placed.where((F.coalesce("_before", F.lit(0)) + F.col("_id") - F.coalesce("_first", F.col("_id"))) % step == 0).select(*df.columns)


def canonical_frames(spark: SparkSession, files: list[File], names: list[str], opened: dict[File, int], max_rows: int | None = None, strict: bool = False, to: dict[str, str] | None = None) -> tuple[DataFrame, dict[File, tuple[float, list[str], bool]]]:
    """_file, _block, _id, ts and channels of files with one header; and for each file the share of sensor-like columns
    that were recognised, warnings, and whether another column could be the time. ``to``: columns to channels, else by rules.

    One pass counts for every file its rows, malformed rows, parsed times and numbers; the frame is a second one.
    Channels without any number in a file are null there; those without one in all files are left out.
    """
    df = scan(spark, files, names)
    hinted = [c for c in names if any(h in label(c) for h in TIME_HINTS)]
    if not hinted:
        raise HarmonizeError("missing_timestamp_column", f"none of {names} looks like a time")
    to = mapping(names) if to is None else to
    col = lambda c: F.col(f"`{c}`")
    # Counts over all columns: with only some of them the reader would not see malformed rows.
    found = df.withColumn("_all", F.struct(*map(col, names))).groupBy("_file").agg(
        F.count(F.lit(1)).alias("n"), F.count(CORRUPT).alias("broken"), F.max(F.hash("_all")).alias("_seen"),
        *(F.avg(parsed_time(col(c)).isNotNull().cast("double")).alias(f"t{i}") for i, c in enumerate(hinted)), *(F.count(col(c).try_cast("double")).alias(f"c{i}") for i, c in enumerate(to)),
    )
    counts = {r._file: r for r in found.collect()}  # one a file
    chosen: dict[str, list[str]] = {}
    told, steps, filled = {}, {}, set()
    for f in files:
        r, warnings = counts.get(f.key), []
        if r is None or not r.n:
            raise HarmonizeError("dataset_empty", f"{f.rel} has no rows")
        if broken := r.broken + opened.get(f, 0):
            raise HarmonizeError("invalid_csv", f"{f.rel} has {broken} malformed rows", rows=broken)
        if max_rows is not None and r.n > max_rows:
            if strict:
                raise HarmonizeError("dataset_too_large", f"{r.n} rows, at most {max_rows}", rows=r.n)
            steps[f.key] = -(-r.n // max_rows)
            warnings.append(f"{r.n} rows, thinned to at most {max_rows}")
        shares = [r[f"t{i}"] or 0.0 for i in range(len(hinted))]
        best = max(range(len(hinted)), key=lambda i: (shares[i], -i))
        if not shares[best]:
            raise HarmonizeError("invalid_timestamp_format", f"no value of {hinted[best]} parses as a time")
        ts = hinted[best]
        chosen.setdefault(ts, []).append(f.key)
        if ambiguous := any(shares[best] - x < 0.1 for i, x in enumerate(shares) if i != best):
            warnings.append(f"{ts} taken as the time, another column parses as well")
        used = {c: x for c, x in to.items() if c != ts}
        like = [c for c in names if c != ts and any(x in label(c) for x in SENSOR_LIKE)]
        for i, c in enumerate(to):
            if c != ts and r[f"c{i}"]:
                filled.add(c)
            elif c != ts:
                warnings.append(f"{c} has no number and is left out")
        told[f] = (round(min(1.0, len(used) / max(1, len(like))), 4), warnings, ambiguous)
    if steps:
        df = thinned_to(df, steps)
    time = F.coalesce(*(F.when(F.col("_file").isin(keys), parsed_time(col(c))) for c, keys in chosen.items()))
    one = lambda c: F.when(F.col("_file").isin(chosen[c]), None).otherwise(col(c).try_cast("double")) if c in chosen else col(c).try_cast("double")
    out = df.select("_file", "_block", "_id", time.alias("ts"), *(one(c).alias(to[c]) for c in to if c in filled)).where("ts is not null")
    return out, told


def read_slot(spark: SparkSession, root: str, dataset_id: str, most_files: int = 250, max_rows: int | None = None, strict: bool = False, mapper: Mapper | None = None) -> Slot:
    """Every CSV below ``root`` as one frame; equal times of a participant become one row, earlier files first.

    ``source_file`` is the first file with a row at that time. Files with the same header are one scan. A header that
    cannot be used fails the slot with its error, if that is one of ``CRITICAL``; any other is skipped with a warning,
    as long as one is left. ``mapper`` is asked about headers of which the rules recognise too little; its answer is
    taken if it is sound.
    """
    files, warnings = find_files(root, most_files)
    owner, grouping = group_files(files)
    files = [f for f in files if f in owner]
    read = headers(spark, files)
    groups: dict[tuple, list[File]] = {}
    for f in files:
        groups.setdefault(tuple(read[f].names), []).append(f)
    frames, told, reasons, method = [], {}, [], "rules"
    for names, members in groups.items():
        try:
            opened = {f: read[f].open_quotes for f in members}
            frame, said = canonical_frames(spark, members, list(names), opened, max_rows, strict)
            by_rules = min(share for share, _, _ in said.values())
            if mapper and by_rules < ASK_BELOW and len(names) <= MOST_ASKED:
                df = scan(spark, members, list(names))
                answer = mapper(list(names), profiles(df, list(names)), preview(df, list(names)))
                taken, why = judged(answer, list(names), by_rules)
                reasons.append(why)
                if taken is not None:
                    method = "mapper"
                    frame, said = canonical_frames(spark, members, list(names), opened, max_rows, strict, taken)
                    said = {f: (round(answer.confidence, 4), w, a) for f, (_, w, a) in said.items()}
        except HarmonizeError as e:
            if e.kind in CRITICAL:
                raise
            warnings += [f"skipped {f.rel}: {e.message}" for f in members]
            continue
        told |= said
        facts = spark.createDataFrame([(f.key, owner[f], i, f.rel) for i, f in enumerate(files) if f in members], "_file string, participant_id string, file_no int, source_file string")
        frames.append(frame.join(F.broadcast(facts), "_file").drop("_file"))  # at most ``most_files`` rows
    if not frames:
        raise HarmonizeError("invalid_dataset_content", f"no file below {root} can be used")
    warnings += [f"{f.rel}: {x}" for f in files if f in told for x in told[f][1]]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    from sensorloom.operators.resample import first_known

    channels = [c for c in CHANNELS if c in whole.columns]
    merged = first_known(whole, ["participant_id", "ts"], [*channels, "source_file"], ["file_no", "_block", "_id"])
    participants = sorted({owner[f] for f in files})
    shares = [told[f][0] for f in files if f in told]
    return Slot(
        merged.withColumn("dataset_id", F.lit(dataset_id)), participants, grouping, modalities_of(channels), round(sum(shares) / len(shares), 4), list(dict.fromkeys(warnings)),
        len(files), any(a for _, _, a in told.values()), method, list(dict.fromkeys(reasons)),
    )
