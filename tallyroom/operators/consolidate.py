"""Merging what authors hand in with the registry, again and again with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.operators.order import allocated_ids

OWNED = ("discoverable_from_blind", "audit_note")


def wave(registry: DataFrame, incoming: DataFrame, new: DataFrame, ledger: DataFrame, prefixes: DataFrame) -> dict[str, DataFrame]:
    """registry with the authors' two columns taken over, the grown ledger, new findings under their numbers, and violations.

    incoming: finding_id and any registry columns (null: not said).  new: label, provisional_id, workstream, title.
    ledger: provisional_id, finding_id of earlier runs; what it holds is not numbered again.  prefixes: workstream, prefix."""
    rest = [c for c in registry.columns if c not in ("finding_id", *OWNED) and c in incoming.columns]
    said = incoming.select("finding_id", *(F.col(c).alias(f"_{c}") for c in (*OWNED, *rest)))
    both = registry.join(said, "finding_id", "left")
    updated = both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in OWNED else F.col(c) for c in registry.columns))
    changed = [both.where(F.col(f"_{c}").isNotNull() & (F.col(f"_{c}") != F.col(c))).select("finding_id", F.lit(f"changes {c}").alias("rule")) for c in rest]
    unknown = incoming.join(registry, "finding_id", "left_anti").select("finding_id", F.lit("unknown id").alias("rule"))
    fresh = new.join(ledger, "provisional_id", "left_anti").join(prefixes, "workstream", "left")
    lost = fresh.where("prefix IS NULL").select(F.col("provisional_id").alias("finding_id"), F.lit("no prefix").alias("rule"))
    violations = unknown.union(lost)
    for c in changed:
        violations = violations.union(c)
    numbered = allocated_ids(fresh.where("prefix IS NOT NULL").select("label", "provisional_id", "prefix"), registry.select("finding_id").union(ledger.select("finding_id")))
    return {"registry": updated, "ledger": ledger.select("provisional_id", "finding_id").union(numbered), "added": numbered.join(new, "provisional_id").select("finding_id", "workstream", "title"), "violations": violations}


def labels(known: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, document_type) of both, and (path, types) where they contradict each other."""
    both = known.select("path", "document_type").union(incoming.select("path", "document_type")).groupBy("path").agg(F.array_sort(F.collect_set("document_type")).alias("types"))
    return both.where(F.size("types") == 1).select("path", F.col("types")[0].alias("document_type")), both.where(F.size("types") > 1)


def ledger_of(status: DataFrame) -> DataFrame:
    """provisional_id, finding_id from lines such as "LABEL-NEW-1 -> CORP-7" of a status text."""
    hits = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9-]+-NEW-[0-9]+)`?\s*(?:->|→|=>)\s*`?([A-Z]+-[0-9]+)"), 0)
    pair = status.select(F.explode(hits).alias("x"))
    return pair.select(F.regexp_extract("x", r"^([A-Za-z0-9-]+-NEW-[0-9]+)", 1).alias("provisional_id"), F.regexp_extract("x", r"([A-Z]+-[0-9]+)$", 1).alias("finding_id")).distinct()


def prefixes(workstreams: list[str], tokens: list[str], existing: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(workstream, prefix) by position, held against (finding_id, workstream) of existing findings."""
    if len(workstreams) != len(tokens):
        raise ValueError("as many prefixes as workstreams are needed")
    out = dict(zip(workstreams, tokens))
    for finding, stream in existing:
        if out.get(stream) != finding.rpartition("-")[0]:
            raise ValueError(f"{finding} is not of {stream}'s prefix")
    return list(out.items())
