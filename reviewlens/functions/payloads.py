"""Fields out of JSON payloads, pages and model replies, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions.labels import NOT_MENTIONED, WORD_TO_CANONICAL
from reviewlens.functions.text import ITEM_ID_SEARCH, item_id, strip_ws, with_scheme


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


REVIEW_PAGE = (
    "struct<model: struct<items: array<struct<"
    "reviewId: string, id: string, reviewRateId: string, reviewContent: string, rating: int, "
    "reviewTime: string, buyerName: string, skuInfo: string, images: array<string>, likeCount: int>>, "
    "paging: struct<totalResults: bigint>>>"
)

SEARCH_PAGE = (
    "struct<mods: struct<listItems: array<struct<"
    "name: string, priceShow: string, originalPriceShow: string, discount: string, productUrl: string, "
    "image: string, ratingScore: string, review: string, itemSoldCntShow: string, itemId: string, "
    "sellerName: string, location: string>>>>"
)


def review_items(payload: Column | str) -> Column:
    """Array of review items of one landed API page."""
    return F.from_json(_col(payload), REVIEW_PAGE)["model"]["items"]


def review_fields(item: Column) -> list[Column]:
    """The eight review fields with their defaults."""
    return [
        F.coalesce(F.nullif(item["reviewId"], F.lit("")), item["id"]).alias("review_id"),
        F.coalesce(item["reviewContent"], F.lit("")).alias("reviewContent"),
        F.coalesce(item["rating"], F.lit(0)).alias("rating"),
        F.coalesce(item["reviewTime"], F.lit("")).alias("reviewTime"),
        F.coalesce(item["buyerName"], F.lit("")).alias("buyerName"),
        F.coalesce(item["skuInfo"], F.lit("")).alias("skuInfo"),
        F.coalesce(item["images"], F.array().cast("array<string>")).alias("images"),
        F.coalesce(item["likeCount"], F.lit(0)).alias("likeCount"),
    ]


def search_items(payload: Column | str, limit: int) -> Column:
    """The first ``limit`` products of a search page (the page's own list order)."""
    return F.slice(F.from_json(_col(payload), SEARCH_PAGE)["mods"]["listItems"], 1, limit)


def search_fields(item: Column) -> list[Column]:
    """The twelve product fields with their defaults."""

    def text(field: str, default: str = "") -> Column:
        return F.coalesce(item[field], F.lit(default))

    own_id = F.nullif(text("itemId"), F.lit(""))
    return [
        text("name", "Unknown").alias("name"),
        text("priceShow", "N/A").alias("price"),
        text("originalPriceShow").alias("original_price"),
        text("discount").alias("discount"),
        with_scheme(item["productUrl"]).alias("url"),
        text("image").alias("image"),
        F.coalesce(item["ratingScore"].try_cast("double"), F.lit(0.0)).alias("rating"),
        F.coalesce(item["review"].try_cast("int"), F.lit(0)).alias("reviews"),
        text("itemSoldCntShow").alias("sold"),
        F.coalesce(own_id, item_id(text("productUrl"), ITEM_ID_SEARCH, missing="")).alias("item_id"),
        text("sellerName").alias("seller"),
        text("location").alias("location"),
    ]


# Field patterns in product pages.
PAGE_TITLE = r"<title>([^|<]+)"
PAGE_PRICE = r'"priceShow":"([^"]+)"'
PAGE_IMAGE = r'"image":"([^"]+)"'
PAGE_RATING = r'"ratingScore":([\d.]+)'
PAGE_STATE = r"window\.__INIT_STATE__\s*=\s*(\{.*?\});"
PAGE_PRODUCT = (
    r'"itemId":"(\d+)".*?"name":"([^"]+)".*?"priceShow":"([^"]+)".*?"productUrl":"([^"]+)"'
)


def page_field(html: Column | str, pattern: str, default: str | None = None) -> Column:
    """First capture of ``pattern``, else ``default``."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(html), pattern, 1), F.lit("")), F.lit(default))


def page_title(html: Column | str, default: str = "Unknown Product") -> Column:
    return strip_ws(page_field(html, PAGE_TITLE, default))


def page_state(html: Column | str, path: str) -> Column:
    """A value of the state object embedded in the page, by JSON path."""
    return F.get_json_object(F.regexp_extract(_col(html), PAGE_STATE, 1), path)


def page_products(html: Column | str) -> Column:
    """All (item_id, name, price, url) of a search page, in page order."""
    groups = [F.regexp_extract_all(_col(html), F.lit(PAGE_PRODUCT), F.lit(g)) for g in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abcd")])
    return F.transform(
        zipped,
        lambda z: F.struct(
            z["a"].alias("item_id"), z["b"].alias("name"), z["c"].alias("price"), with_scheme(z["d"]).alias("url")
        ),
    )


# ----------------------------------------------------------------- model replies

GREEDY_OBJECT = r"(?s)\{.*\}"
FLAT_OBJECT = r"\{[^}]+\}"


def reply_map(reply: Column | str, fallback: str = GREEDY_OBJECT) -> Column:
    """Reply text to map<string,string>: the whole text if it is JSON, else the object in it."""
    raw = _col(reply)
    direct = F.from_json(raw, "map<string,string>")
    inner = F.from_json(F.regexp_extract(raw, fallback, 0), "map<string,string>")
    return F.coalesce(direct, inner)


def reply_labels(reply: Column | str, aspects: Sequence[str], fallback: str = GREEDY_OBJECT) -> Column:
    """Map aspect -> label text; missing aspects read 2; null when nothing was readable."""
    m = reply_map(reply, fallback)
    filled = [x for a in aspects for x in (F.lit(a), F.coalesce(F.element_at(m, a), F.lit(NOT_MENTIONED)))]
    return F.when(m.isNotNull(), F.create_map(*filled))


def reply_words(reply: Column | str, aspects: Sequence[str]) -> Column:
    """Map aspect -> POS / NEG / NEU, null for anything else."""
    m = reply_map(reply)
    out = []
    for a in aspects:
        v = F.element_at(m, a)
        out += [F.lit(a), F.when(v.isin(*WORD_TO_CANONICAL), v)]
    return F.create_map(*out)
