"""Safety predicates and transforms over text, hosts and tool calls."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from folio.functions.text import injection_hits
from folio.operators.patterns import contained

# The syntax of a remote image, and what stands for one.
MEDIA_NOTE = "[远程图片已中和：$1]"
REMOTE_IMAGE = r"!\[([^\]]*)\]\((https?://[^)\s]+)\)"
# Networks that must not be reached.
BLOCKED_V4 = ("0.0.0.0/8", "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")
BLOCKED_V6 = ("::1/128", "fc00::/7", "fe80::/10")
DENY_HITS = 3
FINGERPRINT = 16


def host(url: Column) -> Column:
    """The host of a URL in lower case, without brackets; null if there is none."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"[\[\]]", "")), F.lit(""))


def _v4_number(address: Column) -> Column:
    return F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda number, part: number * 256 + part.try_cast("long"))


@F.pandas_udf(BooleanType())
def _blocked_v6(hosts: pd.Series) -> pd.Series:
    nets = [ipaddress.ip_network(n) for n in BLOCKED_V6]

    def one(h: str | None) -> bool:
        try:
            return h is not None and ":" in h and any(ipaddress.ip_address(h) in n for n in nets)
        except ValueError:
            return False

    return hosts.map(one)


def host_allowed(url: Column, policy: str = "block_private", allow: tuple[str, ...] = (), v6: bool = False) -> Column:
    """Whether a URL may be fetched: ``all``, ``allowlist`` (exact hosts) or ``block_private`` (no local names and no addresses of closed networks).

    Names are not looked up. ``v6`` also tests literal IPv6 addresses, in a UDF; without it they are refused."""
    if policy == "all":
        return F.lit(True)
    h = host(url)
    if policy == "allowlist":
        return F.coalesce(h.isin(list(allow) or [""]), F.lit(False))
    number, literal = _v4_number(h), h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    nets = [ipaddress.ip_network(n) for n in BLOCKED_V4]
    # of an array of one, so that the number is worked out once and not for each network
    inside = F.exists(F.array(number), lambda n: reduce(or_, (n.between(int(net.network_address), int(net.broadcast_address)) for net in nets)))
    closed = F.when(literal, inside).when(F.contains(h, F.lit(":")), _blocked_v6(h) if v6 else F.lit(True)).otherwise(h == "localhost")
    return F.coalesce(~closed, F.lit(False))


def media_pattern(allow: tuple[str, ...] = ()) -> str:
    """Remote images of hosts that aren't allowed; the first group is the host."""
    keep = "|".join(h.replace(".", r"\.") for h in allow)
    return rf"!\[[^\]]*\]\(https?://(?!(?:{keep})[/:?#)])([^)\s/?#:]+)[^)\s]*\)" if keep else r"!\[[^\]]*\]\(https?://([^)\s/?#:]+)[^)\s]*\)"


def neutralise_media(text: Column, allow: tuple[str, ...] = ()) -> Column:
    """Remote images of hosts that aren't allowed become a note of the host; images of the site's own paths stay."""
    return F.regexp_replace(text, media_pattern(allow), MEDIA_NOTE)


def remote_images(text: Column) -> Column:
    return F.regexp_count(text, F.lit(REMOTE_IMAGE))


def leaks(texts: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slices): how many 16-character slices of a secret text stand in each text; texts are walked once, however long the secret."""
    slices = [(i, secret[i : i + FINGERPRINT]) for i in range(0, len(secret) - FINGERPRINT + 1, FINGERPRINT)]
    found = contained(texts, texts.sparkSession.createDataFrame(slices, "slice long, part string"), id_col, text_col, "slice", "part", "slice")
    return texts.select(id_col).join(found.groupBy(id_col).agg(F.count("*").alias("slices")), id_col, "left").fillna(0, ["slices"])


def gate_tools(calls: DataFrame, surfaced: DataFrame, argument: str = "argument", path: str = "filepath") -> DataFrame:
    """Adds ``allowed``: a call is denied if its argument has three injection shapes or more, or names a file that no result has surfaced."""
    known = surfaced.select(F.col(path).alias("__known")).distinct()
    joined = calls.join(known, calls[path] == known["__known"], "left")
    named = F.col(path).isNull() | F.col("__known").isNotNull()
    return joined.withColumn("allowed", named & (injection_hits(F.coalesce(F.col(argument), F.lit(""))) < DENY_HITS)).drop("__known")


def safe_path(path: Column, extensions: tuple[str, ...] = ("md", "html", "htm")) -> Column:
    return ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.rlike(r"^([/\\]|[A-Za-z]:)") & F.lower(path).rlike(rf"\.({'|'.join(extensions)})$")


def asset_id(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{16}$")


def wrap_untrusted(text: Column, source: Column) -> Column:
    """Retrieved text between marks that tell a model to treat it as data; such marks inside the text, in any case, are no marks any more."""
    inside = F.regexp_replace(text, r"(?i)<(/?\s*retrieved)", "&lt;$1")
    return F.concat(F.lit("<retrieved source=\""), F.regexp_replace(source, '"', "'"), F.lit("\">\n"), inside, F.lit("\n</retrieved>"))
