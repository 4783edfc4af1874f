"""URL and identifier functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import URL

IMAGE_CDN, VIDEO_CDN = "https://cdn.bsky.app/img", "https://video.bsky.app/watch"


def netloc(url: Column) -> Column:
    """Lower-case authority with port and user, as it stands; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def canonical(url: Column) -> Column:
    """scheme://netloc/path, scheme and netloc in lower case, no query, fragment or final slashes; null without a path."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when((scheme != "") & (netloc(url) != "") & (path != ""), F.concat(scheme, F.lit("://"), netloc(url), path))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({URL})", 1), F.lit(""))


def under_domain(host: Column, domain: Column) -> Column:
    """Whether a host is a domain or one below it."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def post_uri(source_id: Column) -> Column:
    """at://did/app.bsky.feed.post/rkey of `did/rkey`."""
    return F.concat(F.lit("at://"), F.split_part(source_id, F.lit("/"), F.lit(1)), F.lit("/app.bsky.feed.post/"), F.split_part(source_id, F.lit("/"), F.lit(2)))


def post_target(uri: Column) -> Column:
    """`did/rkey` of a post's URI; null for other URIs."""
    p = r"^at://([^/]+)/app\.bsky\.feed\.post/([^/]+)$"
    return F.when(uri.rlike(p), F.concat(F.regexp_extract(uri, p, 1), F.lit("/"), F.regexp_extract(uri, p, 2)))


def account_target(uri: Column) -> Column:
    """The DID that a label's URI is about as an account: bare, or a profile record."""
    p = r"^(?:at://)?(did:[^/]+)(?:/app\.bsky\.actor\.profile/self)?$"
    return F.nullif(F.regexp_extract(uri, p, 1), F.lit(""))


def reply_author(uri: Column) -> Column:
    return F.split_part(uri, F.lit("/"), F.lit(3))


def permalink(source: Column, source_id: Column, mastodon_url: Column | None = None) -> Column:
    """Public address of a post: built for one platform, given for the other or built from instance and id."""
    a, b = (F.split_part(source_id, F.lit("/"), F.lit(k)) for k in (1, 2))
    own = F.concat(F.lit("https://"), a, F.lit("/statuses/"), b)
    given = F.coalesce(mastodon_url, own) if mastodon_url is not None else own
    return F.when(source == "bluesky", F.concat(F.lit("https://bsky.app/profile/"), a, F.lit("/post/"), b)).otherwise(given)


def image_urls(did: Column, cid: Column) -> Column:
    at = lambda kind: F.concat(F.lit(f"{IMAGE_CDN}/{kind}/plain/"), did, F.lit("/"), cid, F.lit("@jpeg"))
    return F.struct(at("feed_thumbnail").alias("thumbnailUrl"), at("feed_fullsize").alias("fullUrl"))


def playlist_url(did: Column, cid: Column) -> Column:
    return F.concat(F.lit(f"{VIDEO_CDN}/"), did, F.lit("/"), cid, F.lit("/playlist.m3u8"))


def is_public_address(host: str) -> bool:
    """Whether an IP literal is public; names are not looked up and count as not public."""
    import ipaddress

    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast)
