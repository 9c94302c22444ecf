"""Arrow functions for what built-in expressions can't say: strict parsing, literals, feature hashing, exact canonical digests."""

from __future__ import annotations

import ast
import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("ADD_FIELD", "SET_VALUE", "SET_STATUS", "SET_PROVENANCE", "SET_VALIDITY")
ACTION_SCHEMA = T.StructType([
    T.StructField("decision", T.StringType()), T.StructField("affected", T.ArrayType(T.StringType())), T.StructField("n_patches", T.IntegerType()),
    T.StructField("verify_tool", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()),
])


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def _no_constant(name):
    raise ValueError(f"constant {name}")


def _exact_keys(value, keys: set[str], where: str) -> dict:
    if not isinstance(value, dict) or set(value) != keys:
        raise ValueError(f"{where} must hold exactly {sorted(keys)}")
    return value


def parse_action(text: str | None) -> dict:
    """The one JSON object of an action, or a ValueError saying what is wrong with it."""
    body = _exact_keys(json.loads(text or "", object_pairs_hook=_unique, parse_constant=_no_constant), {"decision", "affected_fields", "patches", "verification"}, "action")
    decision, fields, patches, verify = body["decision"], body["affected_fields"], body["patches"], body["verification"]
    if decision not in ("UPDATE", "HOLD", "IGNORE"):
        raise ValueError("unknown decision")
    if not isinstance(fields, list) or not all(isinstance(x, str) and x for x in fields) or len(set(fields)) != len(fields):
        raise ValueError("affected_fields must be distinct strings")
    if not isinstance(patches, list):
        raise ValueError("patches must be a list")
    for p in patches:
        if _exact_keys(p, {"op", "field_id", "value"}, "patch")["op"] not in OPS or p["field_id"] not in fields:
            raise ValueError("patch op or field")
    if verify is not None:
        _exact_keys(verify, {"tool", "field_id"}, "verification")
    if decision == "IGNORE" and (fields or patches or verify):
        raise ValueError("IGNORE carries nothing")
    if decision == "UPDATE" and (not patches or verify):
        raise ValueError("UPDATE needs patches and no verification")
    if decision == "HOLD" and not fields:
        raise ValueError("HOLD needs fields")
    return {"decision": decision, "affected": fields, "n_patches": len(patches), "verify_tool": verify["tool"] if verify else None, "ok": True, "error": None}


@F.pandas_udf(ACTION_SCHEMA)
def strict_action(text: pd.Series) -> pd.DataFrame:
    """Parsed action; anything wrong falls back to IGNORE with ok false and the message."""
    rows = []
    for t in text:
        try:
            rows.append(parse_action(t))
        except (ValueError, TypeError, RecursionError) as e:
            rows.append({"decision": "IGNORE", "affected": [], "n_patches": 0, "verify_tool": None, "ok": False, "error": str(e)[:80]})
    return pd.DataFrame(rows, columns=["decision", "affected", "n_patches", "verify_tool", "ok", "error"])


_QUOTED = re.compile(r"'([^']{1,120})'|\"([^\"]{1,120})\"")
KEY_NAMES = {"name", "id", "type", "value", "status", "result", "response", "data", "message", "error"}


def grounding_terms(value, limit: int = 4, depth: int = 4) -> list[str]:
    """Up to limit distinct leaf strings of a nested value; structured strings are parsed, long ones give their quoted parts."""
    out: list[str] = []

    def add(x, level: int) -> None:
        if len(out) >= limit or level > depth or x is None:
            return
        if isinstance(x, dict):
            for v in x.values():
                add(v, level + 1)
        elif isinstance(x, (list, tuple)):
            for v in x:
                add(v, level + 1)
        else:
            s = str(x).strip()
            if s[:1] in "[{(":
                for parse in (json.loads, ast.literal_eval):
                    try:
                        got = parse(s)
                    except (ValueError, SyntaxError, RecursionError, MemoryError):
                        continue
                    if not isinstance(got, str):
                        add(got, level + 1)
                        return
            terms = [s] if len(s) <= 120 else [a or b for a, b in _QUOTED.findall(s) if (a or b).lower() not in KEY_NAMES]
            for t in terms:
                if t and t not in out and len(out) < limit:
                    out.append(t)

    add(value, 0)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def grounding_terms_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: grounding_terms(t))


_TOKEN = re.compile(r"[\w]+")


def hashed_features(text: str, dims: int = 128, reserved: tuple = ()) -> list[float]:
    """Signed feature hashing by blake2b-64 (little-endian): index h mod dims, sign by bit 8; reserved values lead; unit length."""
    v = [0.0] * dims
    for t in _TOKEN.findall(text.lower()):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if (h >> 8) & 1 else -1.0
    v[: len(reserved)] = reserved
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_features_of(text: pd.Series) -> pd.Series:
    return text.fillna("").map(hashed_features)


@F.pandas_udf(T.StringType())
def canonical_digest(body: pd.Series) -> pd.Series:
    """sha256 of JSON text in canonical form: sorted keys, compact, raw characters, floats as written by repr."""

    def one(t):
        if t is None:
            return None
        return hashlib.sha256(json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return body.map(one)
