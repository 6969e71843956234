"""Request signing, query strings and response classes of the recorded sources (no network here)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sift.config import MIXIN_ORDER, RISK_CODES


def _percent(value: Column) -> Column:
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))


def mixing_key(image_url: Column, sub_url: Column) -> Column:
    """32 characters of the two file names (up to their first dot), taken in the fixed order; NULL if one is empty."""
    name = lambda u: F.substring_index(F.substring_index(u, "/", -1), ".", 1)
    both = F.concat(name(image_url), name(sub_url))
    mixed = F.substring(F.concat(*(F.substring(both, i + 1, 1) for i in MIXIN_ORDER)), 1, 32)
    return F.when((name(image_url) != "") & (name(sub_url) != ""), mixed)


def canonical_query(params: dict[str, Column]) -> Column:
    """Parameters that aren't NULL, by name, percent-encoded, values without !'()*."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(k + "="), F.replace(_percent(F.regexp_replace(v.cast("string"), r"[!'()*]", "")), F.lit("%7E"), F.lit("~")))) for k, v in sorted(params.items())]
    return F.array_join(F.array_compact(F.array(*pairs)), "&")


def signed_query(params: dict[str, Column], key: Column, seconds: Column) -> Column:
    query = canonical_query(params | {"wts": seconds})
    return F.concat(query, F.lit("&w_rid="), F.md5(F.concat(query, key)))


def plain_query(params: dict[str, Column]) -> Column:
    """Parameters that aren't NULL in the given order, form-encoded."""
    return F.array_join(F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(k + "="), F.url_encode(v.cast("string")))) for k, v in params.items()))), "&")


def payload_kind(code: Column, voucher: Column) -> Column:
    """'risk' (a challenge, or one of the risk codes), 'ok' (code 0) or 'api'."""
    return F.when(code.isin(*RISK_CODES) | ((code == 0) & voucher), "risk").when(code == 0, "ok").otherwise("api")


def structural_failure(status: Column, code: Column) -> Column:
    """Whether the endpoint itself is gone, so that the fallback source is asked."""
    return F.coalesce(status.isin(404, 405) | (code == -404), F.lit(False))
