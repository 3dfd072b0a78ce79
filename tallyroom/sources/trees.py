"""Document trees as output: each row becomes a file at its path, and a tree is there whole or not at all.

Rows are written by tasks, each at its own path below a folder that is not yet the tree's; a task that is run again writes the same bytes at the same paths.  Keys and logs
are written beside it in sorted parts, the manifest last, and then the folder gets its name.  If anything fails, the folder goes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tallyroom.functions import text as T
from tallyroom.operators import answerkey, derive
from tallyroom.sources import sinks
from tallyroom.sources.room import RoomError, exists

TREE = "rel_path string, content binary"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


def _system(root: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator) -> Written:
        system, base = _system(self.root)
        files, size, made = 0, 0, set()
        for row in iterator:
            rel, content = row["rel_path"], bytes(row["content"] or b"")
            parts = (rel or "").split("/")
            if not rel or any(p in ("", ".", "..") for p in parts):
                raise ValueError(f"no path below a tree: {rel!r}")
            folder = "/".join([base, *parts[:-1]])
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            # another attempt of this task may be at work on the same path
            with system.open_output_stream(part := f"{folder}/.{uuid.uuid4().hex}") as out:
                out.write(content)
            system.move(part, f"{folder}/{parts[-1]}")
            files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages: list) -> None:
        system, base = _system(self.root)
        system.create_dir(base, recursive=True)  # a tree without documents is a folder too

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, base = _system(self.root)
        if system.get_file_info(base).type != fs.FileType.NotFound:
            system.delete_dir(base)


class DocumentTree(DataSource):
    """df.write.format("document_tree").save(folder): files of (rel_path, content)."""

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def schema(self) -> str:
        return TREE

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def write_tree(files: DataFrame, root: str) -> None:
    """Rows (rel_path, content) as files below ``root``, a path that comes twice being an error."""
    if twice := files.groupBy("rel_path").count().where("count > 1").select("rel_path").take(3):
        raise RoomError(f"written twice: {', '.join(str(r[0]) for r in twice)}")
    files.sparkSession.dataSource.register(DocumentTree)
    files.select(F.col("rel_path").cast("string").alias("rel_path"), F.col("content").cast("binary").alias("content")).write.format("document_tree").mode("append").save(root)


def sorted_lines(lines: DataFrame, path: str, order: str, line: str = "line") -> None:
    """A text table in parts, each sorted and all before the next, so that reading them in order of their names gives sorted lines."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(F.col(line).alias("value")).write.mode("errorifexists").text(path)


def publish(spark: SparkSession, target: str, parts: Callable[[str], None]) -> str:
    """Runs ``parts`` on a folder beside ``target`` and then gives it that name; on any failure nothing is left."""
    if exists(spark, target):
        raise RoomError(f"{target} is there already")
    path = spark._jvm.org.apache.hadoop.fs.Path
    at, new = path(target), path(f"{target.rstrip('/')}.partial-{uuid.uuid4().hex}")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        system.mkdirs(new)
        parts(new.toString())
        if not system.rename(new, at):
            raise RoomError(f"{target} cannot be made")
    except BaseException:
        system.delete(new, True)
        raise
    return target


def text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small new file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def _bytes(files: DataFrame, text: str = "text") -> DataFrame:
    return files.select("rel_path", F.col(text).cast("binary").alias("content"))


# The corrupted twin


def corrupted(docs: DataFrame, key: DataFrame, seed: int, profile: str, sections: list[str], exact_noise: bool = True) -> DataFrame:
    """rel_path, new_path, text, applied (array), and the key's document_type and primary_workstream: every document of the tree, damaged, with its record."""
    out = derive.damaged(docs, seed, profile, sections, exact_noise)
    applied = F.array_compact(F.array(*(F.when(F.col(c), F.lit(said)) for c, said in (("rename", "renamed"), ("misfile", "misfiled"), ("noise", "ocr-noise"), ("truncate", "truncated")))))
    return out.join(key.select(F.col("source_path").alias("rel_path"), "document_type", "primary_workstream"), "rel_path", "left").select("rel_path", "new_path", "text", applied.alias("applied"), "document_type", "primary_workstream")


def corruption_report(twin: DataFrame) -> DataFrame:
    """documents, renamed, misfiled, noised, truncated."""
    count = lambda said: F.count_if(F.array_contains("applied", said))
    return twin.agg(F.count("*").alias("documents"), count("renamed").alias("renamed"), count("misfiled").alias("misfiled"), count("ocr-noise").alias("noised"), count("truncated").alias("truncated"))


def log_line(twin: DataFrame) -> DataFrame:
    """rel_path, line: what was done to each document, as JSON."""
    list_ = F.concat(F.lit("["), F.array_join(F.transform("applied", lambda a: T.json_quoted(a)), ", "), F.lit("]"))
    return twin.select("rel_path", F.concat(F.lit('{"original": '), T.json_quoted(F.col("rel_path")), F.lit(', "corrupted": '), T.json_quoted(F.col("new_path")), F.lit(', "applied": '), list_, F.lit("}")).alias("line"))


def write_corrupted(docs: DataFrame, others: DataFrame, key: DataFrame, target: str, room: str, seed: int, profile: str, sections: list[str], derived_from: str = "", tree: str = "blind") -> dict:
    """The corrupted twin of a tree: damaged documents (rel_path, text) and other files (rel_path, content) as they are, the key with the new paths, a log and a manifest.

    The key must cover the documents, no more and no less.  Gives the report's counts."""
    spark = docs.sparkSession
    here, there = docs.select("rel_path").distinct(), key.select(F.col("source_path").alias("rel_path")).distinct()
    lost, extra = here.subtract(there).count(), there.subtract(here).count()
    if lost or extra:
        raise RoomError(f"the key does not cover the tree: {lost} documents without a record, {extra} records without a document")
    twin = corrupted(docs, key, seed, profile, sections).cache()  # five outputs come from it
    report = corruption_report(twin).first().asDict()

    def parts(folder: str) -> None:
        files = _bytes(twin.select(F.col("new_path").alias("rel_path"), "text")).union(others.select("rel_path", "content"))
        write_tree(files, f"{folder}/{tree}")
        line = answerkey.record_line(F.col("new_path"), F.col("document_type"), F.col("primary_workstream"))
        sorted_lines(twin.select("new_path", line.alias("line")), f"{folder}/answer-key.jsonl", "new_path")
        sorted_lines(log_line(twin), f"{folder}/log.jsonl", "rel_path")
        more = {"derived_from": derived_from} if derived_from else {}
        text_file(spark, f"{folder}/manifest.json", sinks.manifest(files, room, seed=seed, **more))

    try:
        publish(spark, target, parts)
    finally:
        twin.unpersist()
    return report


# The subset


def write_subset(files: DataFrame, findings: DataFrame, total: int, target: str, room: str) -> dict:
    """A subset tree (files: rel_path, content): all evidence and fillers up to ``total``, with the list of paths and roles and the key of the findings that it holds whole."""
    import yaml

    from tallyroom.sources.room import evidence

    spark = files.sparkSession
    carried = evidence(findings).select("finding_id", "rel_path")
    picked = derive.hash_subset(files, carried, total).cache()
    covered = carried.join(picked.select("rel_path", F.lit(1).alias("in")), "rel_path", "left").groupBy("finding_id").agg(F.count_if(F.col("in").isNull()).alias("out")).where("out = 0")
    rows = findings.join(covered, "finding_id", "left_semi").select("finding_id", "severity", F.concat(F.array("source"), "corroboration").alias("evidence")).orderBy("finding_id").collect()  # a key has some hundred findings
    n = picked.count()

    def parts(folder: str) -> None:
        write_tree(files.select("rel_path", "content").join(picked.select("rel_path"), "rel_path", "left_semi"), f"{folder}/subset")
        quoted = F.when(F.col("rel_path").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace("rel_path", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("rel_path"))
        sorted_lines(picked.select("rel_path", F.concat_ws(",", quoted, "role").alias("line")), f"{folder}/subset-manifest.csv", "rel_path")
        said = {"schema_version": 1, "room": room, "subset_documents": n, "findings": [{"id": r["finding_id"], "severity": r["severity"], "evidence": list(r["evidence"])} for r in rows]}
        text_file(spark, f"{folder}/subset-key.yaml", yaml.safe_dump(said, sort_keys=False))

    try:
        publish(spark, target, parts)
    finally:
        picked.unpersist()
    return {"documents": n, "findings": len(rows)}


# The flagged tree


def carrier_tally(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """written, carriers, identical: files of a flagged tree, those with a block (markdown that is evidence), and those as they were."""
    marked = files.select("rel_path").join(evidence.select("rel_path").distinct().withColumn("_e", F.lit(1)), "rel_path", "left")
    carrier = F.coalesce(F.col("_e").isNotNull() & F.col("rel_path").endswith(".md"), F.lit(False))
    return marked.agg(F.count("*").alias("written"), F.count_if(carrier).alias("carriers"), F.count_if(~carrier).alias("identical"))


def write_flagged(files: DataFrame, findings: DataFrame, distractors: DataFrame, target: str, marker: str) -> dict:
    """The flagged twin of a tree (files: rel_path, content): a block of findings behind each document that carries some, other files byte for byte.

    Evidence, and both ends of distractors, must be in the tree; a carrier must be UTF-8."""
    from tallyroom.sources.room import evidence

    spark = files.sparkSession
    carried = evidence(findings).join(findings.select("finding_id", "title", "substance"), "finding_id").select("finding_id", "title", "substance", "rel_path")
    ends = distractors.select("location").union(distractors.select("resolution")).toDF("rel_path")
    absent = carried.select("rel_path").union(ends).distinct().join(files.select("rel_path"), "rel_path", "left_anti")
    if lost := absent.orderBy("rel_path").take(5):
        raise RoomError(f"not in the tree: {', '.join(r[0] for r in lost)}")
    text = F.col("content").cast("string")
    carriers = files.join(carried.select("rel_path").distinct(), "rel_path", "left_semi").where(F.col("rel_path").endswith(".md"))
    if bad := carriers.where(~F.is_valid_utf8(text)).orderBy("rel_path").select("rel_path").take(5):
        raise RoomError(f"no UTF-8: {', '.join(r[0] for r in bad)}")
    blocks = _bytes(sinks.flagged_tree(carriers.select("rel_path", text.alias("text")), carried, marker))
    whole = files.select("rel_path", "content").join(carriers.select("rel_path"), "rel_path", "left_anti").union(blocks)
    publish(spark, target, lambda folder: write_tree(whole, folder))
    return carrier_tally(files, carried).first().asDict()


# The key for people


def wanted_paths(findings: DataFrame, distractors: DataFrame) -> DataFrame:
    """rel_path of all that a key names: evidence, and both ends of distractors."""
    from tallyroom.sources.room import evidence

    ends = distractors.select("location").union(distractors.select("resolution")).toDF("rel_path")
    return evidence(findings).select("rel_path").union(ends).where("rel_path IS NOT NULL").distinct()


def write_key(flagged: DataFrame, findings: DataFrame, distractors: DataFrame, target: str, room: str) -> dict:
    """A key's findings and distractors as text, and the documents that they name from the flagged tree (rel_path, content), in a new folder outside the room."""
    spark = flagged.sparkSession
    plain = lambda p: p.removeprefix("file://").rstrip("/") + "/"
    if plain(target).startswith(plain(room)):
        raise RoomError("a key is never written into its room, where an upload could carry it")
    wanted = wanted_paths(findings, distractors)
    if lost := wanted.join(flagged.select("rel_path"), "rel_path", "left_anti").orderBy("rel_path").take(5):
        raise RoomError(f"not in the flagged tree: {', '.join(r[0] for r in lost)}")

    def parts(folder: str) -> None:
        write_tree(flagged.select("rel_path", "content").join(wanted, "rel_path", "left_semi"), f"{folder}/flagged")
        text_file(spark, f"{folder}/findings.md", sinks.findings_text(findings))
        text_file(spark, f"{folder}/distractors.md", sinks.distractors_text(distractors))

    publish(spark, target, parts)
    return {"findings": findings.count(), "distractors": distractors.count(), "flagged": wanted.count()}


# Scanned slots


def write_scanned(slots: DataFrame, path: str) -> None:
    """The list of scanned slots (slot_id), sorted, as CSV parts with a header."""
    slots.select("slot_id").distinct().repartitionByRange("slot_id").sortWithinPartitions("slot_id").write.mode("errorifexists").csv(path, header=True)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """slot_id of the list of scanned slots; other columns are not read."""
    rows = spark.read.option("header", "true").csv(path)
    if "slot_id" not in rows.columns:
        raise RoomError(f"{path}: no column slot_id")
    return rows.select(F.trim("slot_id").alias("slot_id")).where("slot_id <> ''").distinct()
