"""Joins with small dimensions: services, and address ranges."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.network import in_network, services, v4_number


def with_service(rows: DataFrame, port: str, out: str = "service") -> DataFrame:
    """The service of a port, or the port as text; the table has a few dozen fixed rows."""
    table = F.broadcast(services(rows.sparkSession).withColumnsRenamed({"port": "__port", "service": "__service"}))
    joined = rows.join(table, F.col(port) == F.col("__port"), "left")
    return joined.withColumn(out, F.coalesce("__service", F.col(port).cast("string"))).drop("__port", "__service")


def allowed_addresses(targets: list[str], exclude: list[str] = ()) -> Callable[[Column], Column]:
    """A predicate: within a target and within no exclusion."""
    return lambda address: in_network(address, list(targets)) & ~in_network(address, list(exclude))


def _blocks(ranges: DataFrame) -> DataFrame:
    """The aligned blocks (bits, block) that ranges (low, high) are made of: two of each size at most."""
    sized = ranges.where("low <= high").select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("bits"))
    first, end = F.expr("shiftright(low + shiftleft(1L, bits) - 1, bits)"), F.expr("shiftright(high + 1, bits)")
    sized = sized.select("bits", first.alias("first"), end.alias("end")).where("first < end")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    edges = F.array_compact(F.array(F.when(odd("first"), F.col("first")), F.when(odd("end"), F.col("end") - 1)))
    return sized.select("bits", F.explode(edges).alias("block")).distinct()


def in_number_ranges(rows: DataFrame, number: Column, ranges: DataFrame, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of numbers of 32 bits with a table of ranges (low, high), of any size.

    Ranges are cut into aligned blocks; the distinct numbers are looked up among the blocks of each size that
    there is, 33 at most, by equality, and the rows by number.  Nothing is compared with every range.
    """
    blocks = _blocks(ranges)
    sizes = [r.bits for r in blocks.select("bits").distinct().collect()]  # 33 at most
    keyed = rows.withColumn("__n", number)
    if not sizes:
        return (rows if how == "left_anti" else rows.where("false"))
    numbers = keyed.select("__n").where("__n is not null").distinct()
    filed = numbers.select("__n", F.explode(F.array(*[F.lit(b) for b in sorted(sizes)])).alias("bits"))
    found = filed.withColumn("block", F.expr("shiftright(__n, bits)")).join(blocks, ["bits", "block"], "left_semi").select("__n").distinct()
    return keyed.join(found, "__n", how).select(*rows.columns)


def in_ranges(rows: DataFrame, address: str, ranges: DataFrame, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of IPv4 addresses with a table of ranges (low, high); other text lies in none."""
    return in_number_ranges(rows, v4_number(F.col(address)), ranges, how)


# ---------------------------------------------------------------- addresses of both versions
_PREFIX = "size int, prefix binary"


def _size(version: int, bits: int) -> int:
    return version << 8 | bits


def address_prefixes(ranges: DataFrame) -> DataFrame:
    """The prefixes (size: version and length, prefix: its bytes) that ranges of addresses (low, high, as text) are made of.

    Two of each length at most for a range, whatever its size.  A range that is no range of one version has none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()):
                first, last = _address(low), _address(high)
                if first is not None and last is not None and first.version == last.version and first <= last:
                    found += [(_size(n.version, n.prefixlen), n.network_address.packed) for n in ipaddress.summarize_address_range(first, last)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names=["size", "prefix"])

    return ranges.select("low", "high").mapInArrow(cut, _PREFIX).distinct()


def _address(text: str | None):
    try:
        return None if text is None else ipaddress.ip_address(text)
    except ValueError:
        return None


def in_address_ranges(rows: DataFrame, address: str, ranges: DataFrame, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of IPv4 and IPv6 addresses with a table of ranges (low, high, as text) of either version.

    The distinct addresses are probed, as a trie is walked, at the prefix lengths that occur among the ranges, by
    equality of bytes; then rows are joined by address.  Text that is no address lies in no range.
    """
    prefixes = address_prefixes(ranges)
    sizes = sorted(r["size"] for r in prefixes.select("size").distinct().collect())  # 162 at most
    if not sizes:
        return rows if how == "left_anti" else rows.where("false")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("__a").to_pylist():
                if (a := _address(text)) is not None:
                    whole, n = int(a), a.max_prefixlen
                    for s in sizes:
                        if s >> 8 == a.version:
                            rest = n - (s & 255)
                            found.append((text, s, (whole >> rest << rest).to_bytes(n // 8)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else ([], [], []), (pa.string(), pa.int32(), pa.binary()))], names=["__a", "size", "prefix"])

    keyed = rows.withColumn("__a", F.col(address))
    filed = keyed.select("__a").where("__a is not null").distinct().mapInArrow(probes, f"__a string, {_PREFIX}")
    found = filed.join(prefixes, ["size", "prefix"], "left_semi").select("__a").distinct()
    return keyed.join(found, "__a", how).select(*rows.columns)


def network_ranges(spark, networks: list[str]) -> DataFrame:
    """Networks of either version as ranges (cidr, low, high) of addresses as text."""
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    return spark.createDataFrame([(n.with_prefixlen, str(n.network_address), str(n.broadcast_address)) for n in nets], "cidr string, low string, high string")


def cidr_ranges(spark, networks: list[str]) -> DataFrame:
    """IPv4 networks as ranges; IPv6 networks have no numbers here (``allowed_addresses`` takes both)."""
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    if six := [str(n) for n in nets if n.version == 6]:
        raise ValueError(f"IPv6 networks can't be number ranges: {', '.join(six)}")
    return spark.createDataFrame([(n.with_prefixlen, int(n.network_address), int(n.broadcast_address)) for n in nets], "cidr string, low long, high long")


def expand_hosts(targets: DataFrame, exclude: DataFrame, max_hosts: int | None = None) -> DataFrame:
    """Host addresses (host, number) of IPv4 target ranges (low, high), less the excluded ones, distinct.

    Network and broadcast addresses of ranges of more than two addresses are no hosts.  ``max_hosts`` counts
    what is left after the exclusions.
    """
    wide = F.col("high") - F.col("low") > 1
    inner = targets.select(F.when(wide, F.col("low") + 1).otherwise(F.col("low")).alias("low"), F.when(wide, F.col("high") - 1).otherwise(F.col("high")).alias("high"))
    step = 1 << 12  # a wide range is cut first, so that no row holds all of it
    parts = inner.select("high", F.explode(F.sequence("low", "high", F.lit(step).cast("long"))).alias("low"))
    n = F.explode(F.sequence("low", F.least(F.col("low") + (step - 1), "high"))).alias("number")
    left = in_number_ranges(parts.select(n).distinct(), F.col("number"), exclude, "left_anti")
    if max_hosts is not None and left.limit(max_hosts + 1).count() > max_hosts:
        raise ValueError(f"the scope has more than {max_hosts} hosts")
    n = F.col("number")
    text = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return left.select(text.alias("host"), "number")
