"""Content-hash identities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.canon import tagged_hash

#: The tag of each kind of id, and the version of the records that ids cover.
PAGE, BOOK, PLACEMENT, ANCHOR, SEGMENT = "page-v1", "book-v1", "placement-v1", "anchor-v1", "segment-v1"
OCCURRENCE, CONCEPT, ARTIFACT, EDGE, ATTESTATION = "occurrence-v1", "concept-v1", "artifact-v1", "dependency-edge-v1", "artifact-semantic-attestation-v1"
SCHEMA_VERSION = "schema-v1"


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def json_list(*parts: Column) -> Column:
    """A JSON list of parts that are JSON text."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_object(**parts: Column) -> Column:
    """A JSON object of parts that are JSON text, its keys in order."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]), F.lit("}"))


def ordered(values: Column) -> Column:
    """An array of strings as the JSON list of its sorted distinct values."""
    return F.to_json(F.array_sort(F.array_distinct(values)))


def page_id(sha256: Column) -> Column:
    """Id of a page from the hex hash of its raw bytes."""
    return tagged_hash(PAGE, F.unhex(sha256))


def placement_id(page: Column, sha256: Column, path: Column) -> Column:
    return tagged_hash(PLACEMENT, page, F.unhex(sha256), path)


def book_id(page_ids: Column) -> Column:
    """Id of a book from an array of its page ids."""
    return tagged_hash(BOOK, ordered(page_ids))


def anchor(kind: Column, order: Column, text: Column, other: Column | None = None) -> Column:
    """Structural anchor of a segment; ``other`` is canonical JSON of its fields besides text."""
    return tagged_hash(ANCHOR, json_list(quoted(kind), order.cast("string"), quoted(text), F.lit("{}") if other is None else other))


def segment_id(page: Column, structural_anchor: Column) -> Column:
    return tagged_hash(SEGMENT, page, structural_anchor)


def occurrence_id(segment: Column, start: Column, end: Column, surface: Column) -> Column:
    return tagged_hash(OCCURRENCE, segment, start.cast("string"), end.cast("string"), surface)


def concept_id(lang: Column, form: Column, occurrence_ids: Column) -> Column:
    return tagged_hash(CONCEPT, json_list(quoted(lang), quoted(form), ordered(occurrence_ids)))


def artifact_id(kind: Column, payload: Column, dependency_ids: Column) -> Column:
    """Id of an artifact; ``payload`` is canonical JSON. Findings and semantic keys are no part of it."""
    return tagged_hash(ARTIFACT, json_object(schema_version=quoted(F.lit(SCHEMA_VERSION)), kind=quoted(kind), payload=payload, dependency_ids=ordered(dependency_ids)))


def attestation_id(artifact: Column, kind: Column, key: Column, dependency_ids: Column) -> Column:
    """Id of the statement that an artifact answers a semantic key."""
    return tagged_hash(ATTESTATION, json_object(artifact_id=quoted(artifact), kind=quoted(kind), semantic_key=quoted(key), dependency_ids=ordered(dependency_ids)))


def edge_id(subject: Column, parent: Column, child: Column, stage: Column, kind: Column) -> Column:
    named = {"schema_version": F.lit(SCHEMA_VERSION), "stable_subject_id": subject, "parent_artifact_id": parent, "child_artifact_id": child, "stage": stage, "edge_kind": kind}
    return tagged_hash(EDGE, json_object(**{k: quoted(c) for k, c in named.items()}))


def semantic_key(tag: str, *inputs: Column) -> Column:
    """Key of all that a result depends on; it changes if, and only if, one of the inputs does."""
    return tagged_hash(tag, *[F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in inputs])


#: Tags of the semantic keys.
KEYS = {
    "extraction": "source-extraction-v2", "shard": "evidence-v1", "membership": "membership-v1", "projection": "projection-v1",
    "translation": "translation-v1", "reconciliation": "reconciliation-v1", "validation": "validation-v1", "render": "render-input-v1",
}


def key_of(stage: str, *raw: Column, **fields: Column) -> Column:
    """Semantic key of a stage: ``fields`` are JSON text (see :func:`quoted`, :func:`ordered`), ``raw`` bytes follow them."""
    return tagged_hash(KEYS[stage], json_object(**fields), *raw)


def extraction_key(schema: Column, prompt: Column, executable: Column, model: Column, raw: Column, reasoning: Column) -> Column:
    """Key of a page's extraction: all that the model is given."""
    return key_of("extraction", prompt, raw, extraction_schema=quoted(schema), model_executable_identity=quoted(executable), model_id=quoted(model), reasoning_level=quoted(reasoning))


def membership_key(concept: Column, occurrence_ids: Column, shard_ids: Column, rules: Column) -> Column:
    return key_of("membership", concept_id=quoted(concept), occurrence_ids=ordered(occurrence_ids), evidence_shard_ids=ordered(shard_ids), membership_rules_version=quoted(rules))


def reconciliation_key(page_ids: Column, text_hashes: Column, projection_ids: Column) -> Column:
    """Key of a reconciliation; pages and hashes keep their order, which is part of it."""
    return key_of("reconciliation", effective_page_ids=F.to_json(page_ids), effective_page_text_hashes=F.to_json(text_hashes), projection_ids=ordered(projection_ids))


def fingerprint(prompt: Column) -> Column:
    """The first twelve hex digits of a prompt's SHA-256."""
    return F.left(F.sha2(prompt, 256), F.lit(12))
