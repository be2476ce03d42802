"""The border to an explaining service: what may cross it, what may come back, and how its errors are named.

No client is included: the library has no network.  A caller passes anything with ``generate(payload) -> str``.
"""

from __future__ import annotations

import json
from typing import Any, Protocol
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Keys that would carry rows of a log.
FORBIDDEN = ("raw_csv", "csv", "rows", "raw_data", "dataframe", "records")


class Explainer(Protocol):
    def generate(self, payload: str) -> str: ...


class ExplainError(RuntimeError):
    """A failed explanation: ``code`` is stable, provider texts are never passed on."""

    def __init__(self, code: str, status: int | None = None):
        super().__init__(code)
        self.code, self.status = code, status


def forbidden_keys(value: Any, path: str = "") -> list[str]:
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in ([f"{path}{k}"] if str(k).lower() in FORBIDDEN else []) + forbidden_keys(v, f"{path}{k}.")]
    return [p for v in value for p in forbidden_keys(v, path)] if isinstance(value, (list, tuple)) else []


def forbidden_fields(kind: DataType, path: str = "") -> list[str]:
    """Paths of fields with a forbidden name in the type of a payload."""
    if isinstance(kind, ArrayType):
        return forbidden_fields(kind.elementType, path)
    if isinstance(kind, MapType):
        return forbidden_fields(kind.valueType, path)
    fields = kind.fields if isinstance(kind, StructType) else []
    return [p for f in fields for p in ([f"{path}{f.name}"] if f.name.lower() in FORBIDDEN else []) + forbidden_fields(f.dataType, f"{path}{f.name}.")]


def guarded(payload: str) -> str:
    if found := forbidden_keys(json.loads(payload)):
        raise ValueError(f"raw data must stay here: {', '.join(found)}")
    return payload


def explain(client: Explainer, payload: str) -> str:
    try:
        return client.generate(guarded(payload))
    except (ValueError, ExplainError):
        raise
    except Exception as e:
        raise ExplainError(error_code(e), getattr(e, "status_code", None)) from None


def error_code(e: Exception) -> str:
    status, name = getattr(e, "status_code", None), type(e).__name__.lower()
    by_status = {400: "bad_request", 401: "authentication", 403: "permission", 404: "not_found", 408: "timeout", 429: "rate_limit"}
    if status is not None:
        return by_status.get(status, "server" if status >= 500 else "unknown")
    return next((code for part, code in (("timeout", "timeout"), ("auth", "authentication"), ("connection", "connection"), ("ratelimit", "rate_limit")) if part in name), "unknown")


#: The shape of an answer.  A list of one shape is a list of such objects; no other keys may occur, and none may lack.
TEXT, TEXTS, COUNT = "text", "texts", "count"
REVIEW = {"hypothesis_id": TEXT, "priority": COUNT, "explanation": TEXT, "supporting_evidence": TEXTS, "counter_evidence": TEXTS, "uncertainties": TEXTS}
EXPERIMENT = {"title": TEXT, "purpose": TEXT, "variables_to_change": TEXTS, "variables_to_log": TEXTS, "expected_observation": TEXT, "safety_notes": TEXTS}
ANSWER = {"summary": TEXT, "hypothesis_review": [REVIEW], "additional_hypotheses": TEXTS, "recommended_experiments": [EXPERIMENT], "missing_data_requests": TEXTS}


def shape_type(shape: dict | list | str) -> str:
    """The Spark type of a shape."""
    if isinstance(shape, dict):
        return "struct<" + ",".join(f"{k}:{shape_type(v)}" for k, v in shape.items()) + ">"
    return f"array<{shape_type(shape[0])}>" if isinstance(shape, list) else {TEXT: "string", TEXTS: "array<string>", COUNT: "bigint"}[shape]


def faults(value: Column, shape: dict | list | str, path: Column) -> Column:
    """Where a variant departs from a shape, as an array of (path, code): unknown_key, missing_key, wrong_type, below_one; in the order of the shape."""
    one = lambda code, at=path: F.struct(at.alias("path"), F.lit(code).alias("code"))
    none = F.array().cast("array<struct<path:string,code:string>>")
    kind = F.schema_of_variant(value)
    wrong = lambda ok, inner: F.when(F.coalesce(ok, F.lit(False)), inner).otherwise(F.array(one("wrong_type")))
    if isinstance(shape, dict):
        held, known = value.try_cast("map<string,variant>"), F.array(*map(F.lit, shape))
        key = lambda k: F.concat(path, F.lit("."), k)
        others = F.transform(F.array_sort(F.array_except(F.map_keys(held), known)), lambda k: one("unknown_key", key(k)))
        lacking = F.transform(F.array_except(known, F.map_keys(held)), lambda k: one("missing_key", key(k)))
        inner = [F.when(F.map_contains_key(held, k), faults(F.try_element_at(held, F.lit(k)), sub, key(F.lit(k)))).otherwise(none) for k, sub in shape.items()]
        return wrong(kind.startswith("OBJECT"), F.concat(others, lacking, *inner))
    if shape in (TEXT, COUNT):
        if shape == TEXT:
            return wrong(kind == "STRING", none)
        return wrong(kind == "BIGINT", F.when(value.try_cast("bigint") < 1, F.array(one("below_one"))).otherwise(none))
    item = shape[0] if isinstance(shape, list) else TEXT
    each = F.transform(value.try_cast("array<variant>"), lambda x, k: faults(x, item, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
    return wrong(kind.startswith("ARRAY"), F.flatten(each))


def strict(answers: DataFrame, column: str = "answer", shape: dict = ANSWER) -> DataFrame:
    """``answers`` (JSON texts in ``column``) with ``faults``, an array of (path, code), and ``parsed``, the typed answer where there are none.

    A text that is no JSON, or repeats a key, has the one fault not_json; null counts as such a text.  Types are not bent: "1" and 1.0 are no
    priority.  A bad row is reported and stops nothing.
    """
    value = F.try_parse_json(column)
    found = F.when(value.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("not_json").alias("code")))).otherwise(faults(value, shape, F.lit("$")))
    checked = answers.withColumn("faults", found)
    return checked.withColumn("parsed", F.when(F.size("faults") == 0, F.from_json(column, shape_type(shape))))


def base_url(url: str) -> str:
    """A service address that ends in exactly one /v1."""
    at = urlsplit(url.strip())
    if at.scheme not in ("http", "https") or not at.netloc:
        raise ValueError("not an http address")
    parts = [p for p in at.path.split("/") if p]
    while parts and parts[-1] == "v1":
        parts.pop()
    return urlunsplit((at.scheme, at.netloc, "/" + "/".join([*parts, "v1"]), "", ""))
