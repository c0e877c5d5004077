"""Hashes, canonical JSON, signatures and codecs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

CHUNK_LIMIT, FRAME_LIMIT = 256 * 1024, 512 * 1024


def canonical_json(value: object) -> str:
    """Sorted keys, no white space, letters as they are; whole floats without a fraction."""

    def plain(x: object) -> object:
        if isinstance(x, float) and x.is_integer():
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pandas_udf(T.StringType())
def canonical_json_col(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else canonical_json(json.loads(t)))


def sha256_tag(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def fnv1a(text: Column) -> Column:
    """FNV-1a over the low byte of each UTF-16 unit, as 8 hex digits; a letter beyond the BMP has two units."""
    step = lambda h, x: (h.bitwiseXOR(x.bitwiseAND(255)) * 16777619).bitwiseAND(0xFFFFFFFF)

    def letter(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        beyond = code - 0x10000
        return F.when(code < 0x10000, step(h, code)).otherwise(step(step(h, F.shiftright(beyond, 10)), beyond))

    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("long"), letter)
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def norm_sorted(values: Column) -> Column:
    return F.array_sort(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull()))


def material_fingerprint(name_canonical: Column, country: Column, entity_canonical: Column, aliases: Column, dobs: Column, countries: Column) -> Column:
    """FNV-1a of a JSON of what makes a match materially the same: the customer's canonical name and country, and the entity's
    canonical name, aliases, dates of birth and countries, in any order and case. Other fields of a customer don't count.

    Fixed values: the keys of that JSON and their order, since stored fingerprints are compared.
    """
    low = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    profile = F.struct(low(name_canonical).alias("name_canonical"), low(country).alias("country"))
    entity = F.struct(low(entity_canonical).alias("name_canonical"), norm_sorted(aliases).alias("aliases"), norm_sorted(dobs).alias("dob"), norm_sorted(countries).alias("countries"))
    return fnv1a(F.to_json(F.struct(profile.alias("profile"), entity.alias("entity"))))


@pandas_udf(T.BinaryType())
def unzstd(frames: pd.Series) -> pd.Series:
    """One frame each, with a declared size of at most CHUNK_LIMIT; anything else fails."""
    import zstandard

    def one(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        size = zstandard.frame_content_size(raw)
        if len(raw) > FRAME_LIMIT or not 0 <= size <= CHUNK_LIMIT:
            raise ValueError(f"a frame of {len(raw)} bytes declares {size}")
        decoder = zstandard.ZstdDecompressor().decompressobj()
        out = decoder.decompress(raw)
        if decoder.unused_data or len(out) != size:
            raise ValueError("more than one frame, or not the declared size")
        return out

    return frames.map(one)


def ed25519_verify(spark: SparkSession, public_key: bytes, message: bytes, signature: bytes) -> bool:
    """On the driver, with the JVM's own provider."""
    jvm = spark.sparkContext._jvm
    prefix = bytes.fromhex("302a300506032b6570032100")
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(prefix + public_key))
    verifier = jvm.java.security.Signature.getInstance("Ed25519")
    verifier.initVerify(key)
    verifier.update(message)
    try:
        return bool(verifier.verify(signature))
    except Exception:  # a signature of the wrong length
        return False


def ed25519_keypair(spark: SparkSession) -> tuple[bytes, bytes]:
    """A new key: the raw public part, and the private part in PKCS 8."""
    jvm = spark.sparkContext._jvm
    pair = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory = jvm.java.security.KeyFactory.getInstance("Ed25519")
    spec = lambda key, name: bytes(factory.getKeySpec(key, jvm.java.lang.Class.forName(f"java.security.spec.{name}")).getEncoded())
    return spec(pair.getPublic(), "X509EncodedKeySpec")[-32:], spec(pair.getPrivate(), "PKCS8EncodedKeySpec")


def ed25519_sign(spark: SparkSession, private_key: bytes, message: bytes) -> bytes:
    jvm = spark.sparkContext._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(private_key))
    signer = jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(key)
    signer.update(message)
    return bytes(signer.sign())
