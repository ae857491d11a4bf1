"""Tenant scope, retrieval filters and validity checks."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scheme -> port, and the keys whose values are never shown.
SCHEME_PORTS = {"https": 443, "ssh": 22}
SENSITIVE_KEYS = [
    "password",
    "token",
    "access_token",
    "refresh_token",
    "authorization",
    "jwt_secret_key",
    "secret",
]
REDACTED = "***REDACTED***"

# IPv4 blocks that are private, loopback, link-local, reserved,
# multicast or unspecified, as (network, prefix length, flag). The first match names the flag.
IPV4_BLOCKS = [
    ("0.0.0.0", 32, "unspecified"),
    ("127.0.0.0", 8, "loopback"),
    ("169.254.0.0", 16, "link_local"),
    ("224.0.0.0", 4, "multicast"),
    ("240.0.0.0", 4, "reserved"),
    ("0.0.0.0", 8, "private"),
    ("10.0.0.0", 8, "private"),
    ("172.16.0.0", 12, "private"),
    ("192.0.0.0", 29, "private"),
    ("192.0.0.170", 31, "private"),
    ("192.0.2.0", 24, "private"),
    ("192.168.0.0", 16, "private"),
    ("198.18.0.0", 15, "private"),
    ("198.51.100.0", 24, "private"),
    ("203.0.113.0", 24, "private"),
]


def conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def tenant_predicate(
    workspace_id: Any,
    repository_id: Any = None,
    file_id: Any = None,
    extra: dict[str, Any] | None = None,
) -> Column:
    """The one place a tenant predicate is built."""
    if workspace_id is None:
        raise TypeError("workspace_id is mandatory")
    wanted = {"workspace_id": workspace_id}
    if repository_id is not None:
        wanted["repository_id"] = repository_id
    if file_id is not None:
        wanted["file_id"] = file_id
    wanted |= extra or {}
    return conjunction([F.col(name) == F.lit(value) for name, value in wanted.items()])


def tenant_scope(df: DataFrame, workspace_id: Any, **kwargs: Any) -> DataFrame:
    return df.where(tenant_predicate(workspace_id, **kwargs))


def retrieval_filter(
    df: DataFrame,
    embedding_version: str,
    language: str | None = None,
    symbol_kind: str | None = None,
) -> DataFrame:
    """Active rows of one embedding version; applied before any top-k."""
    conditions = [F.col("is_active"), F.col("embedding_version") == F.lit(embedding_version)]
    if language is not None:
        conditions.append(F.col("language") == F.lit(language))
    if symbol_kind is not None:
        conditions.append(F.col("symbol_kind") == F.lit(symbol_kind))
    return df.where(conjunction(conditions))


def url_problem(url: Column) -> Column:
    """Reason a repository address is refused, or null.

    Checks run in a fixed order: scheme, host, embedded password, user name with
    https, port other than the scheme's own.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    userinfo = F.regexp_extract(authority, r"^(.*)@", 1)
    has_user = F.contains(authority, F.lit("@"))
    hostport = F.regexp_extract(authority, r"([^@]*)$", 1)
    host = F.regexp_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1)
    port = F.regexp_extract(hostport, r":([0-9]+)$", 1)
    own_port = F.lit(None).cast("string")
    for name, number in SCHEME_PORTS.items():
        own_port = F.when(scheme == name, F.lit(str(number))).otherwise(own_port)
    return (
        F.when(~scheme.isin(*SCHEME_PORTS), F.lit("scheme"))
        .when(host.isin("", "[]"), F.lit("host"))
        .when(has_user & F.contains(userinfo, F.lit(":")), F.lit("password"))
        .when(has_user & (scheme == "https"), F.lit("username"))
        .when((port != "") & (port.cast("int").cast("string") != own_port), F.lit("port"))
    )


def validate_repo_url(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("problem", url_problem(F.col(url)))


def _ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    number = reduce(
        lambda total, i: total * 256 + F.get(parts, F.lit(i)).cast("long"),
        range(1, 4),
        F.get(parts, F.lit(0)).cast("long"),
    )
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def ip_flag(ip: Column, number: Column) -> Column:
    """Why an address may not be contacted, ``public``, or ``invalid``.

    ``number`` is the address as an integer, null if it is no IPv4 address.
    """
    v4 = F.lit("public")
    for network, prefix, flag in reversed(IPV4_BLOCKS):
        size = 2 ** (32 - prefix)
        low = sum(int(o) << s for o, s in zip(network.split("."), (24, 16, 8, 0), strict=True))
        v4 = F.when((number >= low) & (number < low + size), F.lit(flag)).otherwise(v4)
    v6 = F.lower(ip)
    return (
        F.when(number.isNotNull(), v4)
        .when(~v6.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$"), F.lit("invalid"))
        .when(v6.rlike(r"^(0{0,4}:){2,7}0{0,4}$"), F.lit("unspecified"))
        .when(v6.rlike(r"^(0{0,4}:){2,7}0{0,3}1$"), F.lit("loopback"))
        .when(v6.rlike(r"^fe[89ab][0-9a-f]:"), F.lit("link_local"))
        .when(v6.rlike(r"^ff[0-9a-f]{2}:"), F.lit("multicast"))
        .when(v6.rlike(r"^f[cd][0-9a-f]{2}:|^2001:0?db8:"), F.lit("private"))
        .when(v6.rlike(r"^[23][0-9a-f]{3}:"), F.lit("public"))
        .otherwise(F.lit("reserved"))
    )


def classify_ip(df: DataFrame, ip: str = "ip") -> DataFrame:
    # The number is a column of its own: it is compared with every block.
    numbered = df.withColumn("_number", _ipv4_number(F.col(ip)))
    return numbered.withColumn("ip_class", ip_flag(F.col(ip), F.col("_number"))).drop("_number")


def find_conflicts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that break the uniqueness of ``keys``.

    Duplicated keys are found by a map-side combined count and joined back, so a
    key holding a large share of the rows is never sorted into one window task
    (AQE splits the skewed join partition).
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return df.join(counted, list(keys), "inner")


def redact_fields(df: DataFrame, keys: list[str] = SENSITIVE_KEYS) -> DataFrame:
    """Hide the values of sensitive keys at any depth of structs, maps and lists."""
    from pyspark.sql import types as T

    lowered = {k.lower() for k in keys}

    def rewrite(value: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            fields = [
                (
                    F.lit(REDACTED)
                    if f.name.lower() in lowered
                    else rewrite(value.getField(f.name), f.dataType)
                ).alias(f.name)
                for f in dtype.fields
            ]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            if isinstance(dtype.valueType, T.StringType):
                return F.transform_values(
                    value,
                    lambda k, v: F.when(F.lower(k).isin(*lowered), F.lit(REDACTED)).otherwise(v),
                )
            return F.transform_values(
                value,
                lambda k, v: F.when(~F.lower(k).isin(*lowered), rewrite(v, dtype.valueType)),
            )
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda v: rewrite(v, dtype.elementType))
        return value

    return df.select(
        *[
            (
                F.lit(REDACTED)
                if f.name.lower() in lowered
                else rewrite(F.col(f"`{f.name}`"), f.dataType)
            ).alias(f.name)
            for f in df.schema.fields
        ]
    )


def validate_dense(df: DataFrame, dim: int | Column, column: str = "dense", strict: bool = True) -> DataFrame:
    """Strict: fail the job on a wrong dimension or a non-finite value.

    Lenient: keep the row and say in ``dense_problem`` what is wrong, so that the
    caller can send it to quarantine.
    """
    v = F.col(column)
    problem = F.when(v.isNull() | (F.size(v) != dim), F.lit("dimension")).when(
        F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        F.lit("not finite"),
    )
    if not strict:
        return df.withColumn("dense_problem", problem)
    return df.withColumn(
        column,
        F.when(problem.isNull(), v).otherwise(
            F.raise_error(F.concat(F.lit("bad dense vector: "), problem))
        ),
    )


def owned_by(df: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows outside the caller's workspaces behave as absent."""
    return df.join(owners.select(*keys), keys, "left_semi")


def route(df: DataFrame, max_tool_calls: int = 3, tool: str = "get_git_blame") -> DataFrame:
    """Next step per turn from (error, intent, hit_count, tool_calls)."""
    calls = F.coalesce(F.col("tool_calls"), F.array().cast("array<string>"))
    wants_tool = (
        (F.size(calls) < max_tool_calls)
        & (F.col("intent") == "debugging")
        & (F.col("hit_count") > 0)
        & ~F.array_contains(calls, tool)
    )
    return df.withColumn(
        "next_step",
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.lit("error_handler"))
        .when(F.col("intent") == "general_chat", F.lit("generate_answer"))
        .otherwise(F.lit("rewrite_query")),
    ).withColumn("next_tool", F.when(F.coalesce(wants_tool, F.lit(False)), F.lit(tool)))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key; Spark prunes each map partition to ``k`` rows per key
    before the shuffle, so a hot key costs ``k`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
