"""Nonces, associated data and sealed blocks (AES-256-GCM) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerstone.functions.codec import be


def nonce(seq: Column, uuid: Column, domain: int) -> Column:
    """7 bytes of seq, 4 of the volume's uuid, 1 of domain."""
    return F.concat(be(seq, 7), uuid, be(F.lit(domain), 1))


def data_aad(volume: Column, block: Column, seq: Column) -> Column:
    return F.concat(F.unhex(F.sha2(volume, 256)), be(block, 8), be(seq, 8))


def meta_aad(volume: Column, tag: Column, state_seq: Column) -> Column:
    return F.concat(F.unhex(F.sha2(volume, 256)), tag.cast("binary"), be(state_seq, 8))


def seal(data: Column, key: Column, iv: Column, aad: Column) -> Column:
    """Ciphertext and tag, without the nonce, which is never stored."""
    return F.substring(F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad), 13, 1 << 30)


def unseal(sealed: Column, key: Column, iv: Column, aad: Column) -> Column:
    """The data; an altered block, key, nonce or aad is an error."""
    return F.aes_decrypt(F.concat(iv, sealed), key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def try_unseal(sealed: Column, key: Column, iv: Column, aad: Column) -> Column:
    """As unseal, but null for an altered block."""
    return F.try_aes_decrypt(F.concat(iv, sealed), key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def mac(document: Column, key: Column, iv: Column, aad: Column) -> Column:
    """Tag over no plaintext, the document being associated data."""
    return F.substring(F.aes_encrypt(F.lit(b"").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.concat(aad, document.cast("binary"))), 13, 16)


def volume_id(kind: str, name: Column, bucket: Column, seconds: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("-", F.lit(kind), name, bucket, seconds.cast("string")), 256), 1, 17))
