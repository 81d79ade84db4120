"""Numbers, vectors, JSON and keys as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def safe_double(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def similarity(distance: Column) -> Column:
    """One less the distance; nothing sensible counts as none."""
    return F.coalesce(F.nanvl(1 - distance.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def score(gain: Column, cost: Column, stealth: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> Column:
    return F.round(alpha * gain - beta * cost + gamma * stealth, 3)


def candidate(json: Column, index: Column) -> Column:
    """A candidate's fields with aliases and defaults, from its JSON."""
    name = F.concat(F.lit("候选方案 "), (index + 1).cast("string"))
    text = lambda key, default: F.coalesce(F.nullif(strip(F.get_json_object(json, f"$.{key}")), F.lit("")), default)
    number = lambda *keys: safe_double(F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys), F.lit("5")), 5)
    return F.struct(
        index.alias("index"), text("name", name).alias("name"), text("plan", F.lit("N/A")).alias("plan"), text("validation", F.lit("N/A")).alias("validation"), text("risk", F.lit("N/A")).alias("risk"),
        number("asr_gain", "ASR_Gain").alias("asr_gain"), number("implementation_cost", "Implementation_Cost").alias("implementation_cost"), number("stealthiness", "Stealthiness").alias("stealthiness"),
    )


def json_list(c: Column) -> Column:
    """An array of strings, or null where the JSON is no list."""
    return F.when(F.startswith(strip(c), F.lit("[")), F.from_json(c, "array<string>"))


def patched(new: Column, old: Column) -> Column:
    """Null keeps the old value, a blank clears it, anything else replaces it."""
    return F.when(new.isNull(), old).when(strip(new) == "", F.lit(None).cast("string")).otherwise(new)


def encrypted(c: Column, secret: str) -> Column:
    """AES-256-CBC under the SHA-256 of a secret, the random start in front, as base64."""
    return F.base64(F.aes_encrypt(F.encode(c, "utf-8"), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("CBC"), F.lit("PKCS")))


def decrypted(c: Column, secret: str) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(c), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("CBC"), F.lit("PKCS")), "utf-8")
