"""The registry of published keys: JSON files named by key id in a folder for each environment.

A file holds one public key. It is rejected, with the first reason that applies, where it is no JSON object, holds the
private member ``d`` (whatever its value), is not named <kid>.json, lacks a coordinate, or where its kid is not the
thumbprint of its key. Whatever else a file holds never leaves the registry: keys are rebuilt from a list of members.

Defined cases: a null or empty content is no JSON object; members that are no strings count as missing; an environment
without keys has no row in ``key_sets``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import codec
from assayline.functions.shapes import text_of
from assayline.operators import card

# The kind of key that signs cards.
KIND, CURVE, USE, ALGORITHM = "EC", "P-256", "sig", "ES256"
#: The members that a published key may carry, in the order of its JSON form.
PUBLIC = ("kty", "crv", "x", "y", "kid", "use", "alg")


@dataclass(frozen=True)
class Registry:
    """keys: env and the public members; rejects: env, file, message."""

    keys: DataFrame
    rejects: DataFrame


def read_registry(spark: SparkSession, path: str) -> Registry:
    """The registry of ``path``: <path>/<env>/<kid>.json; files of other names are left alone."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return load(files.select(F.element_at(F.split(at, "/"), -2).alias("env"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("content")))


def load(files: DataFrame) -> Registry:
    """The registry of ``files`` (env, file, content)."""
    parsed = files.select("env", "file", F.json_object_keys("content").alias("_members"), F.try_parse_json("content").alias("_v"))
    member = {m: text_of(F.col("_v"), f"$.{m}") for m in ("kid", "crv", "kty", "x", "y")}
    read = parsed.select("env", "file", "_members", *(c.alias(m) for m, c in member.items()))
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    kind = ~F.equal_null("kty", F.lit(KIND)) | ~F.equal_null("crv", F.lit(CURVE))
    message = F.coalesce(
        F.when(F.col("_members").isNull(), F.lit("not a JSON object")),
        F.when(F.array_contains("_members", "d"), F.lit('contains a private key member "d"')),
        F.when(~F.equal_null(F.concat("kid", F.lit(".json")), "file"), F.lit("file name must be <kid>.json")),
        F.when(kind | missing("x") | missing("y"), F.lit(f"must be a key of kind {KIND} on {CURVE} with x and y")),
        F.when(codec.thumbprint(F.col("crv"), F.col("kty"), F.col("x"), F.col("y")) != F.col("kid"), F.lit("kid must be the thumbprint of the key")),
    )
    judged = read.withColumn("message", message)
    keys = judged.where("message is null").select("env", F.lit(KIND).alias("kty"), F.lit(CURVE).alias("crv"), "x", "y", "kid", F.lit(USE).alias("use"), F.lit(ALGORITHM).alias("alg"))
    return Registry(keys, judged.where("message is not null").select("env", "file", "message"))


def key_json(key: Column) -> Column:
    """A published key, a struct, as JSON."""
    return card.json_object(*((m, card.json_string(key[m])) for m in PUBLIC))


def key_sets(keys: DataFrame) -> DataFrame:
    """env, n and the document of its keys, ordered by kid. An environment's keys are few: they are one document."""
    listed = keys.groupBy("env").agg(F.array_sort(F.collect_list(F.struct("kid", F.struct(*PUBLIC).alias("key")))).alias("_k"))
    body = F.concat(F.lit('{"keys":['), F.array_join(F.transform("_k", lambda k: key_json(k["key"])), ","), F.lit("]}"))
    return listed.select("env", F.size("_k").alias("n"), body.alias("document"))


def key_states(signers: DataFrame, keys: DataFrame) -> DataFrame:
    """``signers`` (env, active_kid, secret and further columns) with ``ok`` and ``reason``: why an environment can't sign.

    The secret is the private key's JSON; its public half must be the published key of the active kid, which must be its
    thumbprint. The secret itself is not among the columns that come back.
    """
    secret = F.try_parse_json("secret")
    part = {m: text_of(F.col("_v"), f"$.{m}") for m in ("kty", "crv", "x", "y", "d")}
    read = signers.withColumn("_v", secret).withColumns({f"_{m}": c for m, c in part.items()})
    known = keys.select(F.col("env").alias("_env"), F.col("kid").alias("_kid"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    joined = read.join(known, (F.col("env") == F.col("_env")) & (F.col("active_kid") == F.col("_kid")), "left")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    whole = F.equal_null("_kty", F.lit(KIND)) & F.equal_null("_crv", F.lit(CURVE)) & ~empty("_x") & ~empty("_y") & ~empty("_d")
    published = F.equal_null("_px", "_x") & F.equal_null("_py", "_y")
    own = codec.thumbprint(F.col("_crv"), F.col("_kty"), F.col("_x"), F.col("_y"))
    reason = F.when(empty("secret"), "key_missing").when(~whole, "key_invalid").when(~published | ~F.equal_null(own, "active_kid"), "key_mismatch")
    return joined.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).select(*(c for c in signers.columns if c != "secret"), "ok", "reason")
