"""Guards on addresses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that are never public, and the private, loopback, link-local and multicast ranges of addresses.
BLOCKED_HOSTS = ("localhost", "0.0.0.0")
PRIVATE_ADDRESSES = r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.168\.|^192\.0\.0\.|^192\.0\.2\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|23\d|24\d|25[0-5])\."
PRIVATE_ADDRESSES_6 = r"^(?:::1?|::ffff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*)$"


def public_url(url: Column) -> Column:
    """Whether a url is http or https with a host that is public: no local name, no private or multicast address."""
    u = F.coalesce(url, F.lit(""))
    netloc = F.regexp_extract(u, r"^(?i:https?)://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", ""))
    name = F.regexp_replace(host, r"^\[|\]$", "")
    local = name.isin(*BLOCKED_HOSTS) | name.endswith(".local")
    is_address = name.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    return (netloc != "") & ~local & ~(is_address & name.rlike(PRIVATE_ADDRESSES)) & ~(F.contains(name, F.lit(":")) & name.rlike(PRIVATE_ADDRESSES_6))
