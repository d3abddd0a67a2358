"""Corrections as immutable records: their grammar, ids, and the sets that are active."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.canon import canonical_text, nfc
from pagelake.functions.ids import SCHEMA_VERSION
from pagelake.operators.graph import reach
from pagelake.operators.hierarchy import CYCLE, edges_of, hierarchy
from pagelake.operators.memo import activate, active

#: Kinds of corrections and the fields of their scope.
SCOPES = {"source_text": {"segment_id"}, "target_segment": {"segment_id"}, "target_occurrence": {"segment_id", "start", "end"}, "terminology": {"concept_id", "selector"}}
#: Tags of the ids.
CORRECTION, SET, EVENT = "correction-v1", "correction-set-v1", "correction-event-v3"
EVENTS = ("apply", "revert", "supersede")


class Invalid(ValueError):
    """A correction that breaks the grammar."""


def _no_twins(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise Invalid("a key occurs twice")
    return dict(pairs)


def parse(raw: str) -> dict:
    """A correction from JSON text: exact fields, a known kind with its scope, a replacement in NFC."""
    try:
        p = json.loads(raw, object_pairs_hook=_no_twins)
    except json.JSONDecodeError as e:
        raise Invalid(str(e)) from e
    if not isinstance(p, dict) or set(p) != {"kind", "scope", "base", "replacement"}:
        raise Invalid("the fields are kind, scope, base and replacement")
    if p["kind"] not in SCOPES:
        raise Invalid(f"no such kind: {p['kind']}")
    if not isinstance(p["scope"], dict) or not set(p["scope"]) <= SCOPES[p["kind"]] or not p["scope"]:
        raise Invalid(f"the scope of {p['kind']} has {sorted(SCOPES[p['kind']])}")
    if not isinstance(p["base"], dict) or not isinstance(p["replacement"], str) or unicodedata.normalize("NFC", p["replacement"]) != p["replacement"]:
        raise Invalid("base is an object, replacement a string in NFC")
    return p


def _hash(tag: str, **body) -> str:
    return hashlib.sha256(tag.encode() + b"\0" + canonical_text(json.dumps(body)).encode()).hexdigest()


def correction_id(payload: dict, supersedes: str | None = None) -> str:
    """Id of a correction from its content and what it supersedes."""
    return _hash(CORRECTION, payload=payload, supersedes_id=supersedes)


def set_id(base: str, active: list[str], events: list[str]) -> str:
    """Id of a correction set: the base revision, the active corrections and the events that led there."""
    return _hash(SET, schema_version=SCHEMA_VERSION, base_revision_id=base, active_correction_ids=sorted(set(active)), event_ids=sorted(set(events)))


def event_id(correction: str, kind: str, base: str, active: list[str], others: list[str]) -> str:
    """Id of an event; it covers the other events of its set, not itself."""
    after = {"successor_base_revision_id": base, "successor_active_correction_ids": sorted(set(active))}
    return _hash(EVENT, schema_version=SCHEMA_VERSION, correction_id=correction, event_kind=kind, other_event_ids=sorted(set(others)), **after)


def transition(active: set[str], events: list[str], base: str, kind: str, correction: str, supersedes: str | None = None) -> tuple[set[str], list[str]]:
    """(active corrections, events) after applying, reverting or superseding; nothing changes if the step is not allowed."""
    if kind not in EVENTS:
        raise Invalid(f"no such event: {kind}")
    if kind == "revert":
        if correction not in active:
            raise Invalid("only an active correction can be reverted")
        after = active - {correction}
    else:
        if correction in active:
            raise Invalid("the correction is active already")
        if kind == "supersede" and supersedes not in active:
            raise Invalid("only an active correction can be superseded")
        after = active - ({supersedes} if kind == "supersede" else set()) | {correction}
    return after, [*events, event_id(correction, kind, base, sorted(after), events)]


def faults(records: DataFrame) -> DataFrame:
    """(correction_id, fault): the first fault of each record's grammar as columns, null if it has none.

    records: (correction_id, kind, scope, base, replacement) with scope and base as JSON text. Faults in the order of their check:
    kind, scope, scope_fields, base, replacement, not_nfc.
    """
    keys = F.json_object_keys("scope")
    known = F.coalesce(*[F.when(F.col("kind") == k, F.size(F.array_except(keys, F.array(*[F.lit(x) for x in sorted(f)]))) == 0) for k, f in SCOPES.items()])
    fault = (
        F.when(~F.coalesce(F.col("kind").isin(*SCOPES), F.lit(False)), "kind")
        .when(keys.isNull() | (F.size(keys) == 0), "scope")
        .when(~known, "scope_fields")
        .when(F.json_object_keys("base").isNull(), "base")
        .when(F.coalesce(F.trim("replacement") == "", F.lit(True)), "replacement")
        .when(nfc("replacement") != F.col("replacement"), "not_nfc")
    )
    return records.select("correction_id", fault.alias("fault")).dropDuplicates(["correction_id"])


def resolve_set(records: DataFrame, active: DataFrame, base_revision: str, artifacts: DataFrame) -> DataFrame:
    """(correction_id, outcome) for each correction of an active set, in the order of these checks.

    missing: no record; base_mismatch: made for another revision; base_missing: its base artifact is not selected; cycle: its ancestry
    runs into a loop; ancestor_missing: or to no record; ancestor_scope: an ancestor has another kind or scope; superseded: an active
    correction supersedes it; conflict: of those left several have one kind and scope, all of them drop; active: the rest.

    records: (correction_id, kind, scope, base, applies_to_revision_id, supersedes_id), base JSON text with artifact_id; active: (correction_id),
    artifacts: (artifact_id). Repeated rows count once.
    """
    r = records.dropDuplicates(["correction_id"]).withColumn("supersedes_id", F.nullif(F.trim("supersedes_id"), F.lit("")))
    a = active.select("correction_id").where("correction_id is not null").distinct()
    links = edges_of(r, "correction_id", "supersedes_id", "c")
    walk = hierarchy(links, paths=False).groupBy(F.col("node_id").alias("correction_id")).agg(F.bool_or(F.col("root_id") == CYCLE).alias("loop"), F.max("root_id").alias("top"))
    ids = r.select(F.col("correction_id").alias("top"), F.lit(True).alias("top_known"))
    # an ancestor of another kind or scope is one step whose ends differ, somewhere above
    ends = links.select(F.col("child").alias("correction_id"), F.col("parent"))
    own = r.select("correction_id", F.struct("kind", "scope").alias("mine"))
    odd = ends.join(own, "correction_id").join(own.select(F.col("correction_id").alias("parent"), F.col("mine").alias("theirs")), "parent").where("mine <> theirs").select("correction_id")
    below = reach(links.select("parent", "child"), odd.select(F.col("correction_id").alias("node"))).select(F.col("node").alias("correction_id"), F.lit(True).alias("odd"))
    over = r.join(a, "correction_id", "left_semi").where("supersedes_id is not null and supersedes_id <> correction_id").select(F.col("supersedes_id").alias("correction_id")).distinct().withColumn("over", F.lit(True))
    held = artifacts.select("artifact_id").distinct().withColumn("held", F.lit(True))
    j = a.join(r.withColumn("known", F.lit(True)).withColumn("artifact_id", F.get_json_object("base", "$.artifact_id")), "correction_id", "left")
    j = j.join(held, "artifact_id", "left").join(walk, "correction_id", "left").join(ids, "top", "left").join(below, "correction_id", "left").join(over, "correction_id", "left")
    state = (
        F.when(F.col("known").isNull(), "missing")
        .when(~F.col("applies_to_revision_id").eqNullSafe(F.lit(base_revision)), "base_mismatch")
        .when(F.col("held").isNull(), "base_missing")
        .when(F.col("loop"), "cycle")
        .when(F.col("top").isNotNull() & F.col("top_known").isNull(), "ancestor_missing")
        .when(F.col("odd"), "ancestor_scope")
        .when(F.col("over"), "superseded")
    )
    j = j.select("correction_id", "kind", "scope", state.alias("state"))
    n = j.where("state is null").groupBy("kind", "scope").agg(F.count("*").alias("n"))
    return j.join(n, ["kind", "scope"], "left").select("correction_id", F.coalesce("state", F.when(F.col("n") > 1, "conflict").otherwise("active")).alias("outcome"))


def publish(spark: SparkSession, folder: str, base_revision: str, kind: str, raw: str | None = None, correction: str | None = None, supersedes: str | None = None, artifacts: DataFrame | None = None) -> str:
    """Apply, revert or supersede a correction in the store under ``folder``, and give the id of the set that is active then.

    Everything is checked first (grammar, the step itself, the whole resulting set); then records, events and the set are appended, and one
    pointer is swapped. A step that is not allowed writes nothing.
    """
    pointer = f"{folder}/active_set"
    now = active(pointer, spark)
    have, events = set(), []
    if now:
        row = spark.read.parquet(f"{folder}/sets").where(F.col("set_id") == now).first()
        if row["base_revision_id"] != base_revision:
            raise Invalid("the active set belongs to another revision")
        have, events = set(row["active"]), list(row["events"])
    record = None
    if kind != "revert":
        p = parse(raw or "")
        correction = correction_id(p, supersedes)
        record = (correction, p["kind"], canonical_text(json.dumps(p["scope"])), canonical_text(json.dumps(p["base"])), p["replacement"], base_revision, supersedes)
    after, seen = transition(have, events, base_revision, kind, correction, supersedes)
    schema = "correction_id string, kind string, scope string, base string, replacement string, applies_to_revision_id string, supersedes_id string"
    rows = spark.createDataFrame([record] if record else [], schema)
    try:
        stored = spark.read.schema(schema).parquet(f"{folder}/records")
    except AnalysisException:
        stored = spark.createDataFrame([], schema)
    if artifacts is not None:
        found = resolve_set(stored.unionByName(rows), spark.createDataFrame([(x,) for x in sorted(after)], "correction_id string"), base_revision, artifacts)
        bad = found.where("outcome <> 'active'").first()
        if bad:
            raise Invalid(f"{bad['correction_id']} would be {bad['outcome']}")
    ident = set_id(base_revision, sorted(after), seen)
    rows.join(stored.select("correction_id"), "correction_id", "left_anti").select(*stored.columns).write.mode("append").parquet(f"{folder}/records")
    spark.createDataFrame([(ident, base_revision, sorted(after), seen)], "set_id string, base_revision_id string, active array<string>, events array<string>").write.mode("append").parquet(f"{folder}/sets")
    activate(pointer, ident, spark)
    return ident
