"""0/1 flags of both profiles.  Null input always gives 0."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetweave import schema as S


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def local_extended(address: Column) -> Column:
    return flag(address.rlike(S.EXT_LOCAL))


def local_basic(address: Column) -> Column:
    return flag(address.rlike(S.BASIC_LOCAL))


def port_info(info: Column) -> Column:
    return flag(info.rlike(S.EXT_PORT))


def error_extended(info: Column) -> Column:
    return flag(info.rlike(S.EXT_ERROR))


def error_basic(info: Column) -> Column:
    return flag(F.lower(info).rlike(S.BASIC_ERROR))


def protocol_is(protocol: Column, name: str) -> Column:
    return flag(F.upper(protocol) == name)


def http(protocol: Column) -> Column:
    return flag(protocol.contains("HTTP"))


def syn(info: Column) -> Column:
    return flag(info.contains("[SYN]"))


def fin(info: Column) -> Column:
    return flag(info.contains("[FIN"))


def dns_text(info: Column) -> Column:
    return flag(info.rlike(S.BASIC_DNS))


def size_flags(length: Column) -> dict[str, Column]:
    return {
        "size_small": flag(length < S.SMALL_BYTES),
        "size_medium": flag((length >= S.SMALL_BYTES) & (length < S.LARGE_BYTES)),
        "size_large": flag(length >= S.LARGE_BYTES),
    }


def protocol_number(protocol: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*S.PROTOCOL_NUMBERS.items())])
    return F.coalesce(F.try_element_at(table, protocol), F.lit(0))
