"""Readers of source JSON: labels, quotes, links, attachments. Wrong shapes give nulls or empty arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import urls

EMBED = "app.bsky.embed"


def path(raw: Column, at: str) -> Column:
    return F.get_json_object(raw, at)


def listed(raw: Column, at: str, of: str) -> Column:
    """An array of structs at a path; empty where there is none."""
    return F.coalesce(F.from_json(path(raw, at), f"array<{of}>"), F.from_json(F.lit("[]"), f"array<{of}>"))


def self_labels(raw: Column) -> Column:
    return F.filter(F.transform(listed(raw, "$.commit.record.labels.values", "struct<val:string>"), lambda x: x["val"]), lambda v: v.isNotNull())


def has_adult_label(values: Column, adult: tuple[str, ...] = DEFAULT.adult_labels) -> Column:
    return F.exists(values, lambda v: v.isin(*adult))


def raw_url(source: Column, raw: Column, text: Column) -> Column:
    """The link a post is about: the platform's own embed or card, else the first in the text."""
    ext = F.when(path(raw, "$.commit.record.embed.$type") == f"{EMBED}.external", path(raw, "$.commit.record.embed.external.uri"))
    own = F.when(source == "bluesky", ext).when(source == "mastodon", path(raw, "$.card.url"))
    return F.coalesce(own, urls.first_url(text))


def quote_uri(raw: Column) -> Column:
    """URI of a quoted post, of either nesting; other quoted things give null."""
    kind = path(raw, "$.commit.record.embed.$type")
    uri = F.when(kind == f"{EMBED}.record", path(raw, "$.commit.record.embed.record.uri")).when(kind == f"{EMBED}.recordWithMedia", path(raw, "$.commit.record.embed.record.record.uri"))
    return F.when(uri.contains("/app.bsky.feed.post/"), uri)


def link_without_thumbnail(source: Column, raw: Column, text: Column) -> Column:
    """A link that still needs a thumbnail; null where the source has one."""
    e = "$.commit.record.embed"
    blue = F.when((path(raw, f"{e}.$type") == f"{EMBED}.external") & path(raw, f"{e}.external.thumb").isNull(), path(raw, f"{e}.external.uri"))
    image = F.nullif(path(raw, "$.card.image"), F.lit(""))
    mast = F.when(image.isNull(), F.coalesce(path(raw, "$.card.url"), urls.first_url(text)))
    return F.when(source == "bluesky", blue).when(source == "mastodon", mast)


def quote_view(view: Column, filtered: Column) -> Column:
    """What is shown of a quoted post: available with author and text, or why not. Counts of engagement are not read."""
    text, author = path(view, "$.record.text"), path(view, "$.author")
    labels = F.filter(F.transform(listed(view, "$.labels", "struct<val:string>"), lambda x: x["val"]), lambda v: v.isNotNull())
    own = F.filter(F.transform(listed(view, "$.record.labels.values", "struct<val:string>"), lambda x: x["val"]), lambda v: v.isNotNull())
    missing = text.isNull() | author.isNull() | ~F.coalesce(author.startswith("{"), F.lit(False))
    bad = filtered | has_adult_label(labels) | has_adult_label(own)
    reason = F.when(missing, "not_found").when(bad, "filtered")
    who = F.struct(path(view, "$.author.displayName").alias("displayName"), path(view, "$.author.handle").alias("handle"), path(view, "$.author.avatar").alias("avatarUrl"))
    return F.struct(
        F.when(reason.isNull(), "available").otherwise("unavailable").alias("status"),
        reason.alias("reason"),
        F.when(reason.isNull(), who).alias("author"),
        F.when(reason.isNull(), text).alias("text"),
        F.when(reason.isNull(), path(view, "$.record.createdAt")).alias("createdAt"),
    )


ATTACHMENT = "struct<kind:string,url:string,thumbnailUrl:string,fullUrl:string,playlistUrl:string,alt:string,title:string,description:string,providerName:string,isGif:boolean,width:double,height:double>"
_FIELDS = ("kind", "url", "thumbnailUrl", "fullUrl", "playlistUrl", "alt", "title", "description", "providerName", "isGif", "width", "height")


def _attachment(**parts: Column) -> Column:
    kinds = {"isGif": "boolean", "width": "double", "height": "double"}
    return F.struct(*(parts.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in _FIELDS))


def _some(condition: Column, value: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(value)).otherwise(F.from_json(F.lit("[]"), f"array<{ATTACHMENT}>"))


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _http(c: Column) -> Column:
    return F.when(urls.is_http(c), c)


def _media(raw: Column, did: Column, at: str, generated: Column) -> Column:
    """Attachments of one embed: images, a link or a video."""
    kind = path(raw, f"{at}.$type")
    items = listed(raw, f"{at}.images", "struct<alt:string,image:struct<ref:struct<`$link`:string>>,aspectRatio:struct<width:double,height:double>>")

    def image(x):
        u = urls.image_urls(did, x["image"]["ref"]["$link"])
        return _attachment(kind=F.lit("image"), thumbnailUrl=u["thumbnailUrl"], fullUrl=u["fullUrl"], alt=_null_if_empty(x["alt"]), width=x["aspectRatio"]["width"], height=x["aspectRatio"]["height"])

    images = F.transform(F.filter(items, lambda x: x["image"]["ref"]["$link"].isNotNull()), image)
    uri, thumb = path(raw, f"{at}.external.uri"), path(raw, f"{at}.external.thumb.ref.$link")
    link = _attachment(kind=F.lit("link"), url=uri, title=_null_if_empty(path(raw, f"{at}.external.title")), description=_null_if_empty(path(raw, f"{at}.external.description")), thumbnailUrl=F.coalesce(F.when(thumb.isNotNull(), urls.image_urls(did, thumb)["thumbnailUrl"]), _http(generated)))
    cid = path(raw, f"{at}.video.ref.$link")
    video = _attachment(kind=F.lit("video"), playlistUrl=urls.playlist_url(did, cid), isGif=F.coalesce(path(raw, f"{at}.presentation") == "gif", F.lit(False)), width=path(raw, f"{at}.aspectRatio.width").try_cast("double"), height=path(raw, f"{at}.aspectRatio.height").try_cast("double"))
    return F.concat(
        F.when(kind == f"{EMBED}.images", images).otherwise(F.from_json(F.lit("[]"), f"array<{ATTACHMENT}>")),
        _some((kind == f"{EMBED}.external") & urls.is_http(uri), link),
        _some((kind == f"{EMBED}.video") & cid.isNotNull(), video),
    )


def attachments(source: Column, author_id: Column, raw: Column, generated: Column) -> Column:
    """All attachments of a post: media before a quote; the source's own thumbnail before a generated one."""
    e = "$.commit.record.embed"
    kind, q = path(raw, f"{e}.$type"), quote_uri(raw)
    exact = q.rlike(r"^at://[^/]+/app\.bsky\.feed\.post/[^/]+$")
    target = urls.post_target(q)
    quote = _attachment(kind=F.lit("quote"), url=urls.permalink(F.lit("bluesky"), target))
    blue = F.concat(_media(raw, author_id, e, generated), F.when(kind == f"{EMBED}.recordWithMedia", _media(raw, author_id, f"{e}.media", generated)).otherwise(F.from_json(F.lit("[]"), f"array<{ATTACHMENT}>")), _some(exact, quote))
    items = listed(raw, "$.media_attachments", "struct<type:string,url:string,preview_url:string,description:string,meta:struct<original:struct<width:double,height:double>>>")
    good = F.filter(items, lambda m: urls.is_http(m["url"]) & m["type"].isin("image", "video", "gifv"))

    def medium(m):
        still = m["type"] == "image"
        return _attachment(
            kind=F.when(still, "image").otherwise("video"),
            thumbnailUrl=F.coalesce(_http(m["preview_url"]), F.when(still, m["url"])),
            fullUrl=F.when(still, m["url"]),
            playlistUrl=F.when(~still, m["url"]),
            alt=F.when(still, _null_if_empty(m["description"])),
            isGif=F.when(~still, m["type"] == "gifv"),
            width=F.when(~still, m["meta"]["original"]["width"]),
            height=F.when(~still, m["meta"]["original"]["height"]),
        )

    card = _attachment(kind=F.lit("link"), url=path(raw, "$.card.url"), title=_null_if_empty(path(raw, "$.card.title")), description=_null_if_empty(path(raw, "$.card.description")), thumbnailUrl=F.coalesce(_http(path(raw, "$.card.image")), _http(generated)), providerName=_null_if_empty(path(raw, "$.card.provider_name")))
    mast = F.concat(F.transform(good, medium), _some(urls.is_http(path(raw, "$.card.url")), card))
    return F.when(source == "bluesky", blue).otherwise(mast)


def sensitive(raw: Column) -> Column:
    return F.coalesce(path(raw, "$.sensitive") == "true", F.lit(False)) | (F.size(listed(raw, "$.commit.record.labels.values", "string")) > 0)
