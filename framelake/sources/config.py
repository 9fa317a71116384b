"""Configuration and message text: INI sections, JSON dictionaries, digests and authentication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ini_values(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """(doc, section, key, value): a section's name carries forward over its lines."""
    section = F.regexp_extract(F.col(line), r"^\s*\[([^\]]+)\]\s*$", 1)
    w = Window.partitionBy(doc).orderBy(pos)
    df = lines.withColumn("section", F.last(F.nullif(section, F.lit("")), ignorenulls=True).over(w))
    df = df.where(F.col(line).rlike(r"^\s*[^\[;#=\s][^=]*="))
    return df.select(doc, F.coalesce("section", F.lit("")).alias("section"), F.trim(F.regexp_extract(F.col(line), "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract(F.col(line), "=(.*)$", 1)).alias("value"))


def health(json: Column) -> Column:
    """active, duration in seconds, skipped, total and congestion of a status dictionary; malformed text gives nulls."""
    return F.from_json(json, "active boolean, duration double, skipped long, total long, congestion double", {"mode": "PERMISSIVE"})


def content_digest(size: Column, content: Column) -> Column:
    """SHA-256 over the size in decimal and the whole content."""
    return F.sha2(F.concat(size.cast("string").cast("binary"), content.cast("binary")), 256)


def auth_response(password: Column, salt: Column, challenge: Column) -> Column:
    """base64(sha256(base64(sha256(password + salt)) + challenge))"""
    once = F.base64(F.unhex(F.sha2(F.concat(password, salt), 256)))
    return F.base64(F.unhex(F.sha2(F.concat(once, challenge), 256)))


#: Numbers of the messages that are received.
HELLO, IDENTIFIED, EVENT, RESPONSE = 0, 2, 5, 7


def message(text: Column) -> Column:
    """An envelope {op, d} as a struct: malformed, kind (hello, identified, event, response or unknown) and the fields of its kind.

    Malformed is text that isn't JSON, isn't an object or has no whole number as op. A kind
    whose fields are missing or of another type is unknown; so is every other op.
    """
    v = F.try_parse_json(text)
    # only a value that is a string, number or boolean in the text counts as one
    is_a = lambda path, *kinds: F.schema_of_variant(F.try_variant_get(v, path, "variant")).isin(*kinds)
    get = lambda path, kind, *kinds: F.when(is_a(path, *kinds), F.try_variant_get(v, path, kind))
    string = lambda path: get(path, "string", "STRING")
    whole = lambda path: get(path, "long", "BIGINT")
    held = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))
    op = F.when(held("$"), whole("$.op"))
    event, request, about = string("$.d.eventType"), string("$.d.requestId"), string("$.d.requestType")
    ok, code = get("$.d.requestStatus.result", "boolean", "BOOLEAN"), whole("$.d.requestStatus.code")
    rpc, challenge, salt = whole("$.d.rpcVersion"), string("$.d.authentication.challenge"), string("$.d.authentication.salt")
    signed = ~held("$.d.authentication") | (challenge.isNotNull() & salt.isNotNull())
    kind = (
        F.when((op == HELLO) & rpc.isNotNull() & signed, "hello").when(op == IDENTIFIED, "identified").when((op == EVENT) & event.isNotNull(), "event")
        .when((op == RESPONSE) & request.isNotNull() & about.isNotNull() & ok.isNotNull() & code.isNotNull(), "response").otherwise("unknown")
    )
    only = lambda k, c: F.when(kind == k, c)
    return F.struct(
        op.isNull().alias("malformed"), kind.alias("kind"), only("hello", rpc).alias("rpc_version"), only("hello", challenge).alias("challenge"), only("hello", salt).alias("salt"),
        F.coalesce(only("event", event), only("response", about)).alias("type"), only("response", request).alias("request_id"), only("response", ok).alias("ok"), only("response", code).alias("code"),
        only("response", string("$.d.requestStatus.comment")).alias("comment"),
        F.to_json(F.coalesce(F.when((kind == "event") & held("$.d.eventData"), F.try_variant_get(v, "$.d.eventData", "variant")), F.when((kind == "response") & held("$.d.responseData"), F.try_variant_get(v, "$.d.responseData", "variant")))).alias("data"),
    )
