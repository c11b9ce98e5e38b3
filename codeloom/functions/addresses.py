"""Network addresses of both families as column expressions: one canonical form, one key of bits, networks by prefix.

An IPv4 address is 32 bits, an IPv6 address 128, both as texts of 0 and 1, so that a network is the texts that begin with
its prefix, and addresses meet networks by equi joins, one for each length of a prefix. IPv4 addresses that are
written as IPv6 ones are IPv4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Networks whose addresses no client has: unset, loopback, link-local, private, shared by a carrier, multicast.
NOT_PUBLIC = (
    "0.0.0.0/32", "127.0.0.0/8", "169.254.0.0/16", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "224.0.0.0/4",
    "::/128", "::1/128", "fe80::/10", "fec0::/10", "ff00::/8",
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once; null stays null."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def _four(text: Column) -> Column:
    """The eight hexadecimal digits of four decimal numbers; null if one is over 255 or the form is another."""
    parts = F.transform(F.split(F.when(text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), text), "[.]"), lambda p: p.cast("int"))
    return _let(parts, lambda n: F.when(F.array_max(n) <= 255, F.lower(F.array_join(F.transform(n, lambda p: F.lpad(F.hex(p), 2, "0")), ""))))


def key(address: Column) -> Column:
    """8 or 32 hexadecimal digits of an address, spaces around it and a zone after % aside; null if it is none."""
    group = "[0-9a-f]{1,4}"

    def six(text: Column) -> Column:
        """Of a text in which a decimal tail is two groups already."""
        halves = F.split(F.when(text.rlike(f"^({group}(:{group}){{7}}|({group}(:{group})*)?::({group}(:{group})*)?)$"), text), "::")
        groups = lambda h, k: F.filter(F.split(F.coalesce(F.try_element_at(h, F.lit(k)), F.lit("")), ":"), lambda g: g != "")

        def whole(parts: Column) -> Column:
            missing = 8 - F.size(parts["a"]) - F.size(parts["b"])
            fits = F.when(parts["short"], missing >= 1).otherwise(missing == 0)
            every = F.concat(parts["a"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), parts["b"])
            return F.when(fits, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

        digits = _let(halves, lambda h: F.when(h.isNotNull(), _let(F.struct(groups(h, 1).alias("a"), groups(h, 2).alias("b"), (F.size(h) > 1).alias("short")), whole)))
        return _let(digits, lambda d: F.when(F.startswith(d, F.lit("0" * 20 + "ffff")), F.substring(d, 25, 8)).otherwise(d))

    def tailed(text: Column) -> Column:
        tail = F.when(text.rlike(r":[0-9]+\.[0-9.]+$"), F.regexp_extract(text, r":([0-9.]+)$", 1))
        both = F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), _let(_four(tail), lambda t: F.concat(F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4))))
        return _let(F.when(tail.isNotNull(), both).otherwise(text), six)

    return _let(F.lower(F.trim(address)), lambda text: F.when(F.contains(text, F.lit(":")), _let(F.regexp_replace(text, "(?<=.)%.*$", ""), tailed)).otherwise(_four(text)))


def canonical(address: Column) -> Column:
    """An address in the one form that all its spellings share, groups of IPv6 without leading zeros; null if it is none."""
    parts = lambda d, n: F.transform(F.sequence(F.lit(0), (F.length(d) / n - 1).cast("int")), lambda k: F.substr(d, (k * n + 1).cast("int"), F.lit(n)))
    four = lambda d: F.array_join(F.transform(parts(d, 2), lambda x: F.conv(x, 16, 10)), ".")
    six = lambda d: F.array_join(F.transform(parts(d, 4), lambda x: F.regexp_replace(x, "^0{1,3}", "")), ":")
    return _let(key(address), lambda d: F.when(F.length(d) == 8, four(d)).when(F.length(d) == 32, six(d)))


def bits(address: Column) -> Column:
    """The 32 or 128 bits of an address as a text; null if it is none."""
    return F.array_join(F.transform(F.split(key(address), "(?<=.)(?=.)"), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")


def _network_bits(cidr: str) -> tuple[int, str]:
    """The bits of an address of the network's family and those of its prefix."""
    import ipaddress

    n = ipaddress.ip_network(cidr.strip(), strict=False)
    if n.version == 6 and n.prefixlen >= 96 and n.network_address.ipv4_mapped:
        n = ipaddress.ip_network(f"{n.network_address.ipv4_mapped}/{n.prefixlen - 96}")
    return n.max_prefixlen, format(int(n.network_address), f"0{n.max_prefixlen}b")[: n.prefixlen]


def in_networks(address: Column, cidrs: list[str] | tuple[str, ...]) -> Column:
    """Whether an address is in one of a few networks, such as 10.0.0.0/8, fe80::/10 or one address."""
    known = F.array(*[F.struct(F.lit(size).alias("size"), F.lit(prefix).alias("prefix")) for size, prefix in map(_network_bits, cidrs)])
    return F.coalesce(_let(bits(address), lambda own: F.exists(known, lambda n: (F.length(own) == n["size"]) & F.startswith(own, n["prefix"]))), F.lit(False))


def is_public(address: Column) -> Column:
    """Whether it is an address that a client may have."""
    known = [(size, prefix) for size, prefix in map(_network_bits, NOT_PUBLIC)]
    closed = F.array(*[F.struct(F.lit(size).alias("size"), F.lit(prefix).alias("prefix")) for size, prefix in known])
    return F.coalesce(_let(bits(address), lambda own: own.isNotNull() & ~F.exists(closed, lambda n: (F.length(own) == n["size"]) & F.startswith(own, n["prefix"]))), F.lit(False))


def client_address(forwarded: Column, trusted: list[str]) -> Column:
    """From the right, the first public address of a comma-separated list that no trusted network holds, in canonical form; null if none."""
    parts = F.reverse(F.split(forwarded, ","))
    sound = F.filter(parts, lambda x: is_public(x) & ~in_networks(x, trusted) if trusted else is_public(x))
    return canonical(F.try_element_at(sound, F.lit(1)))


def longest_match(rows: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    """rows with network: of networks (cidr) the one with the longest prefix that holds the address, null without one.

    Each address meets networks by its prefixes of the lengths that networks have, 162 at most; what is not a network matches nothing.
    """
    parts = F.split("cidr", "/")
    size = F.length(bits(parts[0]))
    length = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), size)
    known = networks.select("cidr", size.alias("size"), length.alias("length"), F.substr(bits(parts[0]), F.lit(1), length).alias("prefix"))
    known = known.where("length between 0 and size").groupBy("size", "length", "prefix").agg(F.min("cidr").alias("network"))
    lengths = [(r["size"], r["length"]) for r in known.select("size", "length").distinct().collect()]  # 162 at most
    if not lengths:
        return rows.withColumn("network", F.lit(None).cast("string"))
    own = rows.select(address).distinct().withColumn("__bits", bits(F.col(address)))
    tried = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(n).alias("length")) for s, n in sorted(lengths)]))
    each = own.where("__bits is not null").select(address, "__bits", tried.alias("t")).where(F.length("__bits") == F.col("t.size"))
    each = each.select(address, "t.size", "t.length", F.substr("__bits", F.lit(1), F.col("t.length")).alias("prefix"))
    best = each.join(known, ["size", "length", "prefix"]).groupBy(address).agg(F.max_by("network", "length").alias("network"))
    return rows.join(best, address, "left")
