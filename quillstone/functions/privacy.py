"""Keys that must not cross a boundary, at any depth of a JSON payload.

The walk is a recursive query: each step opens the objects and arrays of the step before. Members come in document order,
as maps keep it, and their types from variants, so text that looks like an object isn't opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forbidden keys, and fragments that forbid a key that holds them.
EXACT = set(
    "client_id client_name client_email client_phone client_address client_dob date_of_birth tfn abn_holder_name internal_notes internal_note selected_by_user_id staff_id "
    "created_by updated_by assigned_user_id other_connection_id connection_ids workspace_ids cost_price cost margin markup wholesale_price aml_case_id screening_result risk_rating".split()
)
FRAGMENTS = "client_email client_phone client_name internal_note margin aml_ smr suspic austrac".split()

# What no key of a client's view may hold.
CLIENT_RESTRICTED = r"(?i)(risk_(rating|score)|screening|sanction|pep(\b|_)|adverse|match_|mlro|suspic|smr(\b|_)|austrac|reviewer_note|internal_note|decision_note|rationale|biometric|liveness_score|face_match|provider_(payload|reference|secret)|storage_(path|bucket)|access_token|secret|api_key)"

#: Levels of a payload that a walk goes down; a deeper payload fails the job, so that none passes unread.
DEPTH = 500

# A step numbers what it opens, so that places sort in document order. Only what starts like an object or array can be one, so
# variants are made only where something does (91 and 123 are the brackets); text isn't opened, and only what will be opened keeps its body.
_OPENED = """transform(array(from_json(body, '{shape}<{of}string>')), m -> CASE WHEN exists({values}, s -> ascii(s) IN (91, 123))
        THEN zip_with({variants}, {members}, (v, s) -> struct({name} AS name, CASE WHEN ascii({text}) IN (91, 123) THEN left(schema_of_variant({value}), 5) END AS kind, {text} AS body))
        ELSE transform({members}, s -> struct({name} AS name, CAST(NULL AS STRING) AS kind, CAST(NULL AS STRING) AS body)) END)[0]"""
_ARRAY = _OPENED.format(shape="array", of="", values="m", variants="from_json(body, 'array<variant>')", members="m", name="CAST(NULL AS STRING)", text="s", value="v")
_OBJECT = _OPENED.format(shape="map", of="string,", values="map_values(m)", variants="map_entries(from_json(body, 'map<string,variant>'))", members="map_entries(m)", name="s.key", text="s.value", value="v.value")
_WALK = f"""
WITH RECURSIVE walk(owner, path, place, name, kind, body, hit) MAX RECURSION LEVEL {{depth}} AS (
  SELECT owner, '', CAST(array() AS ARRAY<INT>), CAST(NULL AS STRING), left(schema_of_variant(try_parse_json(payload)), 5), payload, false FROM {{payloads}}
  UNION ALL
  SELECT owner, path, place, name, kind, CASE WHEN kind IN ('ARRAY', 'OBJEC') THEN body END, hit FROM (
    SELECT owner, concat(path, CASE WHEN kind = 'ARRAY' THEN concat('[', pos, ']') WHEN path = '' THEN member.name ELSE concat('.', member.name) END) AS path, array_append(place, pos) AS place,
      member.name AS name, member.kind AS kind, member.body AS body, coalesce(transform(array(member.name), name -> {{found}})[0], false) AS hit
    FROM walk, LATERAL posexplode(CASE WHEN kind = 'ARRAY' THEN {_ARRAY} ELSE {_OBJECT} END) AS opened(pos, member)
    WHERE kind IN ('ARRAY', 'OBJEC'){{within}}
  ){{kept}}
)
SELECT owner, place, path, name, hit FROM walk
"""


# Whether ``name`` is forbidden in any of its spellings, as SQL.
_SNAKE = "lower(regexp_replace(name, '([a-z0-9])([A-Z])', '$1_$2'))"
FORBIDDEN = f"({_SNAKE} IN ({', '.join(repr(x) for x in sorted(EXACT))}) OR {' OR '.join(f'contains({_SNAKE}, {x!r})' for x in FRAGMENTS)})"


def walk(payloads: DataFrame, key: str, payload: str, stop: str | None = None) -> DataFrame:
    """owner (the payload's key), place, path and name of everything in the payloads, each payload itself first.

    ``stop``: SQL on ``name``; nothing below a key that meets it is looked at. Names are read as JSON, so no escape hides
    one; of a key that an object has twice both members are opened. Null and what isn't JSON have themselves alone. The
    walk sets the session's row limit of recursion off, as payloads of any number are walked.
    """
    return _walked(payloads, key, payload, stop or "false", stop is not None, False).drop("hit")


def _walked(payloads: DataFrame, key: str, payload: str, found: str, stop: bool, only: bool) -> DataFrame:
    """The walk with hit, whether ``found`` (SQL on ``name``) holds; ``stop``: nothing below a hit is looked at; ``only``:
    nothing else is kept than hits and what is opened."""
    spark = payloads.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    held = payloads.select(F.col(key).alias("owner"), F.col(payload).alias("payload"))
    opened = "kind IN ('ARRAY', 'OBJEC')"
    parts = {"depth": str(DEPTH), "found": found, "within": " AND NOT hit" if stop else "", "kept": f" WHERE hit OR {opened}" if only else ""}
    text = _WALK
    for name, part in parts.items():
        text = text.replace(f"{{{name}}}", part)
    return spark.sql(text, payloads=held)


def _listed(payloads: DataFrame, key: str, payload: str, found: str, stop: bool = False) -> DataFrame:
    held = _walked(payloads, key, payload, found, stop, True).where(F.col("hit") | (F.size("place") == 0))
    each = F.sort_array(F.collect_list(F.when(F.col("hit"), F.struct("place", "path"))))
    return held.groupBy(F.col("owner").alias(key)).agg(F.transform(each, lambda x: x["path"]).alias("paths"))


def _quoted(text: str) -> str:
    """Text as a literal of SQL that holds no braces, which would be read as the name of a frame."""
    return "decode(unhex('" + text.encode().hex() + "'), 'UTF-8')"


def forbidden_paths(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key and paths: the dotted paths of forbidden keys in document order, none below another; key must be each payload's own."""
    return _listed(payloads, key, payload, FORBIDDEN, True)


def restricted_paths(payloads: DataFrame, key: str, payload: str, pattern: str = CLIENT_RESTRICTED) -> DataFrame:
    """key and paths: the dotted paths of the keys that match, in document order, at any depth."""
    return _listed(payloads, key, payload, f"name RLIKE {_quoted(pattern)}")


def has_keys(payloads: DataFrame, key: str, payload: str, **names: list[str]) -> DataFrame:
    """key and a boolean for each list of names: whether the payload has a key of it at any depth; null for null."""
    present = lambda held: F.coalesce(F.bool_or(F.col("name").isin(*held)), F.lit(False))
    wanted = f"name IN ({', '.join(_quoted(x) for held in names.values() for x in held) or 'NULL'})"
    sides = _walked(payloads, key, payload, wanted, False, True).groupBy("owner").agg(*[present(held).alias(c) for c, held in names.items()])
    stated = payloads.select(F.col(key), F.col(payload).isNotNull().alias("_stated"))
    return stated.join(sides, F.col(key).eqNullSafe(F.col("owner"))).select(key, *[F.when(F.col("_stated"), F.col(c)).alias(c) for c in names])
