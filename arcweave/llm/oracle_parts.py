"""Pieces of SQL that several checks share."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of an expression whose code points lie below 2048: bit by
    bit over the bytes, each followed by seven zeros, with the reflected polynomial."""
    bytes_ = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END))"
    bits = f"flatten(list_transform({bytes_}, lambda b: [b::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(c, v) & 1 = 1 THEN xor(xor(c, v) >> 1, 3988292384) ELSE xor(c, v) >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, v: {step}), 4294967295)"
