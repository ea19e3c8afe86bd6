"""Keyword lexicons and the matching expressions built from them.

A lexicon is a parameter of every rule operator. Big ones come from a table
(aspect, role, keyword) through :meth:`Lexicon.from_table`; the small ones below are
defaults. Matching is by substring, so a keyword also fires inside a longer word.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.labels import ASPECTS

GENERAL = "*"  # aspect value of keywords that belong to no single aspect
MAX_LITERAL_KEYWORDS = 2000  # beyond this a lexicon is joined, not written into the plan


@dataclass(frozen=True)
class AspectWords:
    nouns: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lexicon:
    aspects: dict[str, AspectWords]
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    neutral: tuple[str, ...] = ()
    contrast: tuple[str, ...] = ()
    extra: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def from_rows(cls, rows: Iterable[tuple[str, str, str]]) -> Lexicon:
        """Rows (aspect, role, keyword); roles noun, positive, negative, neutral, contrast.
        Aspect ``*`` holds the general words; aspects keep their order of appearance."""
        by_aspect: dict[str, dict[str, list[str]]] = {}
        general: dict[str, list[str]] = {}
        for aspect, role, keyword in rows:
            home = general if aspect == GENERAL else by_aspect.setdefault(aspect, {})
            home.setdefault(role, []).append(keyword)
        return cls(
            aspects={
                a: AspectWords(
                    tuple(r.get("noun", ())), tuple(r.get("positive", ())), tuple(r.get("negative", ()))
                )
                for a, r in by_aspect.items()
            },
            **{k: tuple(general.get(k, ())) for k in ("positive", "negative", "neutral", "contrast")},
        )

    @classmethod
    def from_table(cls, table: DataFrame, order: str | None = None) -> Lexicon:
        """Read a lexicon table onto the driver; refuses one too big to be part of a plan."""
        cols = table.select("aspect", "role", "keyword", *([order] if order else []))
        rows = (cols.orderBy(order) if order else cols).take(MAX_LITERAL_KEYWORDS + 1)
        if len(rows) > MAX_LITERAL_KEYWORDS:
            raise ValueError("lexicon too large for literals; use lexicon_join on the table")
        return cls.from_rows((r["aspect"], r["role"], r["keyword"]) for r in rows)

    def rows(self) -> list[tuple[str, str, str]]:
        out = [
            (a, role, k)
            for a, w in self.aspects.items()
            for role, words in (("noun", w.nouns), ("positive", w.positive), ("negative", w.negative))
            for k in words
        ]
        for role in ("positive", "negative", "neutral", "contrast"):
            out += [(GENERAL, role, k) for k in getattr(self, role)]
        return out


# ------------------------------------------------------------------- expressions


def minimal(keywords: Sequence[str]) -> list[str]:
    """Keywords that contain no other one: enough to answer "any contained?"."""
    kept: list[str] = []
    for k in sorted(set(keywords), key=lambda k: (len(k), k)):
        if not any(s in k for s in kept):
            kept.append(k)
    return kept


def balanced(columns: Sequence[Column], join: Callable[[Column, Column], Column], empty: Column) -> Column:
    """The columns joined pairwise, so that the depth of the expression grows with the logarithm of their number."""
    if not columns:
        return empty
    if len(columns) == 1:
        return columns[0]
    half = len(columns) // 2
    return join(balanced(columns[:half], join, empty), balanced(columns[half:], join, empty))


def trie_pattern(keywords: Sequence[str]) -> str:
    """One pattern for "any of the keywords", shaped like their trie: keywords with the same beginning share it, so at
    each place of a text only one way is tried."""
    trie: dict[str, dict] = {}
    for k in minimal(keywords):
        node = trie
        for ch in k:
            node = node.setdefault(ch, {})

    def written(node: dict[str, dict]) -> str:
        # minimal keywords: none begins another, so a node without children is an end
        ends = [ch for ch, rest in node.items() if not rest]
        ways = [re.escape(ch) + written(rest) for ch, rest in node.items() if rest]
        if len(ends) > 1:
            ways.append("[" + "".join(map(re.escape, ends)) + "]")
        elif ends:
            ways.append(re.escape(ends[0]))
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""

    return written(trie)


TRIE_FROM = 100  # so many keywords take longer one by one than in one pattern


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    kept = minimal(keywords)
    if len(kept) >= TRIE_FROM and kept[0]:
        return text.rlike("(?s)" + trie_pattern(kept))
    return balanced([F.contains(text, F.lit(k)) for k in kept], operator.or_, F.lit(False))


def count_contained(text: Column, keywords: Sequence[str]) -> Column:
    """How many distinct keywords occur."""
    return balanced([F.contains(text, F.lit(k)).cast("int") for k in dict.fromkeys(keywords)], operator.add, F.lit(0))


def keyword_positions(text: Column, keywords: Sequence[str]) -> Column:
    """All zero-based positions where any keyword starts, overlaps included, sorted.

    One pass marks the first character of every hit; the marks are then read off character
    by character, so the cost is linear in the text.
    """
    # a keyword that begins with another one starts nowhere new
    starts = [k for k in keywords if not any(k != s and k.startswith(s) for s in keywords)]
    alternatives = "|".join(map(re.escape, dict.fromkeys(starts)))
    mark, other = "\x01", "\x02"
    marked = F.regexp_replace(F.translate(text, mark, other), f"(?s)(?=(?:{alternatives})).", mark)
    at = F.transform(F.split(marked, ""), lambda c, i: F.when(c == mark, i))
    return F.filter(at, lambda i: i.isNotNull())


def context_window(text: Column, position: Column, before: int, after: int) -> Column:
    """Characters ``[position - before, position + after)``, cut at the text's ends."""
    start = F.greatest(position - before, F.lit(0))
    return F.substring(text, start + 1, position + after - start)


# ------------------------------------------------------- fixed values: small lexicons

DOC_POSITIVE = ["tốt", "đẹp", "nhanh", "chất lượng", "hài lòng", "good", "great"]
DOC_NEGATIVE = ["xấu", "chậm", "kém", "tệ", "thất vọng", "bad", "poor"]

SIMPLE = Lexicon(
    aspects={
        "Chất lượng sản phẩm": AspectWords(
            positive=("đẹp", "tốt", "chất lượng", "bền", "chắc", "mịn", "đẹp lắm", "ổn", "ok", "ưng"),
            negative=("xấu", "tệ", "kém", "mỏng", "dở", "lỗi", "hỏng", "rách", "bong", "tróc"),
        ),
        "Hiệu năng & Trải nghiệm": AspectWords(
            positive=("dùng tốt", "xài được", "sử dụng ok", "chạy mượt", "nhanh", "êm"),
            negative=("dùng tệ", "khó dùng", "chậm", "lag", "nóng", "hao pin", "khó sử dụng"),
        ),
        "Đúng mô tả": AspectWords(
            positive=("đúng hình", "giống hình", "như mô tả", "đúng mẫu", "đúng size", "như ảnh"),
            negative=("khác hình", "không giống", "sai màu", "sai size", "không như", "lừa đảo"),
        ),
        "Giá cả & Khuyến mãi": AspectWords(
            positive=("rẻ", "giá tốt", "hợp lý", "đáng tiền", "hời", "giá ok", "sale"),
            negative=("đắt", "mắc", "giá cao", "không đáng", "chặt chém"),
        ),
        "Vận chuyển": AspectWords(
            positive=("giao nhanh", "ship nhanh", "nhanh lắm", "shipper tốt", "đúng hẹn"),
            negative=("giao chậm", "ship chậm", "trễ", "lâu", "delay", "đợi lâu"),
        ),
        "Đóng gói": AspectWords(
            positive=("đóng gói cẩn thận", "gói kỹ", "đóng gói đẹp", "bọc kỹ", "an toàn"),
            negative=("đóng gói sơ sài", "móp", "bẹp", "hư hộp", "không cẩn thận"),
        ),
        "Dịch vụ & Thái độ Shop": AspectWords(
            positive=("shop nhiệt tình", "tư vấn tốt", "shop ok", "seller tốt", "thân thiện"),
            negative=("shop tệ", "thái độ kém", "không nhiệt tình", "không rep"),
        ),
        "Bảo hành & Đổi trả": AspectWords(
            positive=("đổi nhanh", "hoàn tiền", "bảo hành tốt", "hỗ trợ đổi"),
            negative=("không đổi", "không bảo hành", "từ chối đổi", "không hoàn"),
        ),
        "Tính xác thực": AspectWords(
            positive=("chính hãng", "hàng thật", "auth", "real", "xịn"),
            negative=("hàng giả", "fake", "nhái", "không phải hàng thật", "hàng dỏm"),
        ),
    },
    positive=("tốt", "đẹp", "ok", "ổn", "ưng", "thích"),
    negative=("tệ", "xấu", "dở", "thất vọng"),
)

GATED = Lexicon(
    aspects={
        "Chất lượng sản phẩm": AspectWords(
            nouns=("vải", "chất", "form", "bền", "nặng", "nhẹ", "mịn", "thô", "cứng", "mềm", "chất lượng", "đẹp", "xấu", "tốt", "kém", "mỏng", "dày"),
            positive=("tốt", "đẹp", "chất lượng", "bền", "chắc", "mịn", "ok", "ổn"),
            negative=("xấu", "tệ", "kém", "mỏng", "dở", "lỗi", "hỏng", "rách", "thất vọng"),
        ),
        "Hiệu năng & Trải nghiệm": AspectWords(
            nouns=("dùng", "xài", "sử dụng", "hoạt động", "chạy", "pin", "nhanh", "chậm", "trải nghiệm"),
            positive=("dùng tốt", "xài được", "ok", "nhanh", "hiệu quả"),
            negative=("dùng tệ", "khó dùng", "chậm", "lag", "rụng", "thất vọng", "không hiệu quả"),
        ),
        "Đúng mô tả": AspectWords(
            nouns=("giống hình", "đúng mô tả", "như ảnh", "khác hình", "không giống", "quảng cáo"),
            positive=("đúng hình", "giống hình", "như mô tả", "đúng", "như ảnh"),
            negative=("khác hình", "không giống", "sai", "không đúng", "lừa đảo", "quảng cáo sai"),
        ),
        "Giá cả & Khuyến mãi": AspectWords(
            nouns=("giá", "tiền", "rẻ", "đắt", "voucher", "mã giảm", "sale", "hời"),
            positive=("rẻ", "giá tốt", "hợp lý", "đáng tiền", "hời"),
            negative=("đắt", "mắc", "giá cao", "không đáng", "chặt chém"),
        ),
        "Vận chuyển": AspectWords(
            nouns=("ship", "giao", "nhanh", "chậm", "shipper", "vận chuyển", "lâu"),
            positive=("giao nhanh", "ship nhanh", "nhanh lắm", "shipper tốt", "đúng hẹn"),
            negative=("giao chậm", "ship chậm", "trễ", "lâu", "delay", "đợi lâu"),
        ),
        "Đóng gói": AspectWords(
            nouns=("đóng gói", "hộp", "bọc", "bubble", "bị móp", "bẹp", "cẩn thận"),
            positive=("đóng gói cẩn thận", "gói kỹ", "đóng gói đẹp", "bọc kỹ"),
            negative=("đóng gói sơ sài", "móp", "bẹp", "hộp", "không cẩn thận"),
        ),
        "Dịch vụ & Thái độ Shop": AspectWords(
            nouns=("shop", "seller", "hỗ trợ", "tư vấn", "nhiệt tình", "thái độ", "vô trách nhiệm"),
            positive=("shop nhiệt tình", "tư vấn tốt", "shop ok", "seller tốt", "thân thiện"),
            negative=("shop tệ", "thái độ kém", "không nhiệt tình", "vô trách nhiệm"),
        ),
        "Bảo hành & Đổi trả": AspectWords(
            nouns=("bảo hành", "đổi", "trả", "hoàn", "lỗi", "sửa chữa"),
            positive=("đổi nhanh", "hoàn tiền", "bảo hành tốt", "hỗ trợ đổi"),
            negative=("không đổi", "không bảo hành", "từ chối đổi"),
        ),
        "Tính xác thực": AspectWords(
            nouns=("chính hãng", "auth", "fake", "nhái", "thật", "giả"),
            positive=("chính hãng", "hàng thật", "auth", "real", "xịn"),
            negative=("hàng giả", "fake", "nhái", "không phải hàng thật"),
        ),
    },
    contrast=("nhưng", "mà", "tuy nhiên", "song", "nhưng mà", "tuy", "dù"),
)

# Keys are older aspect names, so of the nine canonical aspects only the first is refined.
RATING = Lexicon(
    aspects={
        "Chất lượng sản phẩm": AspectWords(
            positive=("chất lượng tốt", "chất lượng", "đẹp", "bền", "chắc chắn", "tuyệt vời"),
            negative=("kém", "xấu", "tệ", "lỗi", "hỏng", "rách", "dở"),
        ),
        "Giá cả": AspectWords(
            positive=("giá tốt", "rẻ", "hợp lý", "đáng tiền", "phải chăng", "giá rẻ"),
            negative=("đắt", "mắc", "không đáng", "giá cao", "chặt chém"),
        ),
        "Vận chuyển & giao hàng": AspectWords(
            positive=("giao nhanh", "nhanh", "đúng hạn", "giao hàng tốt", "ship nhanh"),
            negative=("giao chậm", "chậm", "trễ", "delay", "lâu", "đợi lâu"),
        ),
        "Đóng gói & bao bì": AspectWords(
            positive=("đóng gói cẩn thận", "đóng gói đẹp", "gói kỹ", "đóng gói tốt"),
            negative=("đóng gói kém", "móp", "bẹp", "hư hộp", "đóng gói sơ sài"),
        ),
        "Uy tín & thái độ shop": AspectWords(
            positive=("shop uy tín", "nhiệt tình", "tư vấn tốt", "thân thiện", "shop tốt"),
            negative=("shop tệ", "thái độ kém", "không nhiệt tình", "lừa đảo"),
        ),
    },
)

VALIDATION = Lexicon(
    aspects={
        "Chất lượng sản phẩm": AspectWords(
            negative=("mỏng", "kém", "tệ", "xấu", "thất vọng", "dở", "lỗi", "hỏng", "rách"),
            positive=("đẹp", "tốt", "chất lượng", "bền", "ok", "ổn", "ưng"),
        ),
        "Hiệu năng & Trải nghiệm": AspectWords(
            negative=("rụng", "tệ", "kém hiệu quả", "không hiệu quả", "thất vọng"),
            positive=("hiệu quả", "tốt", "ok", "dùng được"),
        ),
        "Đúng mô tả": AspectWords(
            negative=("không đúng", "sai", "khác", "lừa đảo", "quảng cáo sai"),
            positive=("đúng", "giống hình", "như mô tả", "chính xác"),
        ),
        "Vận chuyển": AspectWords(
            negative=("chậm", "lâu", "trễ", "delay", "giao lâu"),
            positive=("nhanh", "giao nhanh", "ship nhanh", "đúng hẹn"),
        ),
        "Đóng gói": AspectWords(
            negative=("móp", "bẹp", "hư", "sơ sài", "không cẩn thận"),
            positive=("cẩn thận", "kỹ", "đẹp", "chắc chắn"),
        ),
        "Dịch vụ & Thái độ Shop": AspectWords(
            negative=("vô trách nhiệm", "tệ", "thái độ kém", "không nhiệt tình"),
            positive=("nhiệt tình", "tốt", "hỗ trợ", "thân thiện"),
        ),
    },
    contrast=("nhưng", "mà", "tuy nhiên", "song", "nhưng mà"),
)

CONTEXT_V1_CONTRAST = ["nhưng", "tuy nhiên", "tuy", "mặc dù", "dù"]
CONTEXT_V2_CONTRAST = ["nhưng", "tuy", "tuy nhiên", "mặc dù", "dù", "song", "còn", "nhưng mà", "tuy vậy"]
SHORT_POSITIVE = ["tốt", "đẹp", "ổn", "ok", "được", "ưng", "thích", "good", "nice"]
SHORT_NEGATIVE = ["tệ", "xấu", "dở", "kém", "bad", "terrible"]

assert list(SIMPLE.aspects) == ASPECTS and list(GATED.aspects) == ASPECTS
