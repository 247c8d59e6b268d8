"""Column functions for encrypted values; keys are binary columns or literals.

New values are sealed with AES-GCM, which notices changes. AES-CBC with the initialisation
vector in front is there to read and write values in that older layout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seal(plain: Column, key: Column) -> Column:
    """AES-GCM of a binary or text value; a null stays null."""
    return F.aes_encrypt(plain, key, F.lit("GCM"))


def unseal(sealed: Column, key: Column) -> Column:
    """The plain bytes; raises if key or value isn't the right one."""
    return F.aes_decrypt(sealed, key, F.lit("GCM"))


def seal_cbc(plain: Column, key: Column, vector: Column | None = None) -> Column:
    """AES-CBC, padded to blocks, its 16-byte vector in front; random unless given."""
    options = (F.lit("CBC"), F.lit("PKCS"))
    return F.aes_encrypt(plain, key, *options) if vector is None else F.aes_encrypt(plain, key, *options, vector)


def unseal_cbc(sealed: Column, key: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("CBC"), F.lit("PKCS"))
