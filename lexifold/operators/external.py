"""Outside services: requests are columns, the transport is the caller's.

A transport is a function (list of requests) -> list of answers, called once a
batch on the executors. Requests are built and can be tested without it.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col
from ..ship import ship


def map_batches(df: DataFrame, request: str, field: str, transport, kind=None, batch: int = 100, on_error: str = "text") -> DataFrame:
    """df with field = the transport's answers to the request column.

    on_error: "text" puts "Error: .." in the field, "null" leaves it null, "drop"
    drops the row, "raise" stops.
    """
    ship(df.sparkSession)
    kind = kind or T.StringType()
    keep = [c for c in df.columns if c != field]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(field, kind)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches):
        for b in batches:
            asks = b.column(request).to_pylist()
            out, kept = [], []
            for at in range(0, len(asks), batch):
                part = asks[at : at + batch]
                try:
                    got = list(transport(part))
                except Exception as e:
                    if on_error == "raise":
                        raise
                    got = [f"Error: {e}" if on_error == "text" else None] * len(part)
                    if on_error == "drop":
                        continue
                out += got
                kept += range(at, at + len(part))
            rows = b.select(keep).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, arrow)], [*keep, field])

    return df.mapInArrow(run, schema)


def map_parts(df: DataFrame, requests: str, field: str, transport, joiner: str = " ", batch: int = 100) -> DataFrame:
    """df with field = the answers to an array of requests, joined; a row that lacks an answer is dropped, one without requests has an empty text."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != field]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(field, T.StringType())])

    def run(batches):
        for b in batches:
            asks = b.column(requests).to_pylist()
            flat = [r for a in asks for r in a or []]
            got: list = []
            for at in range(0, len(flat), batch):
                part = flat[at : at + batch]
                try:
                    got += list(transport(part))
                except Exception:
                    got += [None] * len(part)
            out, kept, at = [], [], 0
            for i, a in enumerate(asks):
                own = got[at : at + len(a or [])]
                at += len(a or [])
                if a is not None and None not in own:
                    kept.append(i)
                    out.append(joiner.join(own))
            rows = b.select(keep).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string())], [*keep, field])

    return df.mapInArrow(run, schema)


def chat_request(content, model: str, system: str = "", temperature: float = 0.7, max_tokens: int = 1000, style: str = "openai") -> Column:
    """The JSON body of a chat completion: "openai", "claude" (system apart) or "ollama" (options, no stream)."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = message("user", col(content))
    both = [message("system", F.lit(system)), user] if system and style != "claude" else [user]
    fields = [F.lit(model).alias("model"), F.array(*both).alias("messages")]
    if style == "claude":
        fields += [F.lit(system).alias("system")] if system else []
    if style == "ollama":
        fields += [F.lit(False).alias("stream"), F.struct(F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("num_predict")).alias("options")]
    else:
        fields += [F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens")]
    return F.to_json(F.struct(*fields))


def chat_answer(c, style: str = "openai") -> Column:
    """The text in a completion's JSON answer."""
    path = {"openai": "$.choices[0].message.content", "claude": "$.content[0].text", "ollama": "$.message.content"}[style]
    return F.get_json_object(col(c), path)


def prompt(template: str) -> Column:
    """A template with {field}s as a column."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for i, p in enumerate(parts) if i % 2 or p])


def digest_input(c) -> Column:
    """A text over 20 characters as its first ten, its length and its last ten."""
    t, n = col(c), F.char_length(col(c))
    return F.when(n > 20, F.concat(F.substring(t, 1, 10), n.cast("string"), F.substring(t, n - 9, F.lit(10)))).otherwise(t)


def sign_sha256(c, app: str, salt: str, time: str, secret: str) -> Column:
    return F.sha2(F.concat(F.lit(app), digest_input(c), F.lit(salt + time + secret)).cast("binary"), 256)


def sign_md5(c, app: str, salt: str, secret: str) -> Column:
    return F.md5(F.concat(F.lit(app), col(c), F.lit(salt + secret)).cast("binary"))


def search_request(c, fields, style: str = "azure", size: int = 10) -> Column:
    """A search service's request: JSON ("azure", "tencent") or a query string ("aws")."""
    if style == "azure":
        return F.to_json(F.struct(col(c).alias("search"), F.lit("simple").alias("queryType"), F.lit(size).alias("top"), F.lit(",".join(fields)).alias("select")))
    if style == "tencent":
        return F.to_json(F.struct(F.struct(col(c).alias("query"), F.array(*[F.lit(f) for f in fields]).alias("fields")).alias("simple_query")))
    return F.concat(F.lit("q="), F.url_encode(col(c)), F.lit(f"&size={size}&return={','.join(fields)}"))


def signing_key(secret: str, date: str, region: str, service: str) -> bytes:
    """The day's key of the public SigV4 scheme; date as yyyyMMdd."""
    key = b"AWS4" + secret.encode()
    for part in (date, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def split_chunks(c, most: int = 5000) -> Column:
    """A text in pieces of at most `most` characters, cut after a sentence end where a piece has one."""
    return F.regexp_extract_all(col(c), F.lit(rf"(?s).{{1,{most}}}$|.{{0,{most - 1}}}[.!?。！？\n]|.{{1,{most}}}"), F.lit(0))


def hashing_encoder(dims: int = 64):
    """A deterministic stand-in for an encoder: hashed words, unit length."""

    def encode(texts):
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dims
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return encode


def embed(chunks: DataFrame, encode, field: str = "embedding") -> DataFrame:
    """chunks (.., chunk) with their vectors."""
    return map_batches(chunks, "chunk", field, encode, T.ArrayType(T.DoubleType()), on_error="raise")


def rerank(df: DataFrame, query: str, score, k: int = 0) -> DataFrame:
    """df by the caller's score(list of (query, content)) downwards; ties by id."""
    asked = map_batches(df, "content", "score", lambda texts: [float(s) for s in score([(query, t) for t in texts])], T.DoubleType(), on_error="raise")
    out = asked.orderBy(F.col("score").desc(), "id")
    return out.limit(k) if k else out


def pack_floats(df: DataFrame, vector: str, field: str) -> DataFrame:
    """df with a vector as base64 of little-endian 32-bit floats."""
    import base64

    import numpy as np

    return map_batches(df, vector, field, lambda vs: [base64.b64encode(np.asarray(v, "<f4").tobytes()).decode() for v in vs], on_error="raise")


def token_estimate(c) -> Column:
    return F.floor(F.char_length(col(c)) / 4)
