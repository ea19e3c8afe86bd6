from reviewlens.functions import text as T


def test_clean_basic_keeps_inner_runs(apply):
    raw = "Sản phẩm tuyệt vời! <br> Giao hàng nhanh."
    assert apply(T.clean_basic, [raw, None]) == ["sản phẩm tuyệt vời   giao hàng nhanh", ""]


def test_clean_stream_collapses(apply):
    raw = "Sản phẩm tuyệt vời! <br> Giao hàng nhanh."
    assert apply(T.clean_stream, [raw, None, " a  b\x85"]) == ["sản phẩm tuyệt vời! giao hàng nhanh.", "", "a b"]


def test_full_normaliser(apply):
    got = apply(T.normalise_full, ["SP đẹpppp   quá!!! ok 😀😀", "sz", "", None])
    assert got == ["sản phẩm đẹp quá ! tốt", "cỡ", "", None]


def test_single_steps(apply):
    assert apply(T.punct_collapse, ["a?!.b"]) == ["a?b"]
    assert apply(T.collapse_repeats, ["aabb\n\ncc\r\rd", "😀😀x"]) == ["ab\n\nc\rd", "😀x"]
    assert apply(T.strip_emoji, ["a😀🎉b‍c漢字d"]) == ["a b c d"]
    assert apply(T.strip_outer, ["  \\!a b.\t", " ! a"]) == ["a b", " a"]
    assert apply(T.punct_spacing, ["a,b .c!"]) == ["a , b .c !"]  # matches never overlap


def test_typos_apply_in_order(apply):
    assert apply(lambda c: T.normalise_typos(c, passes=1), ["ok đẹp"]) == ["okhông đẹp"]


def test_signature(apply):
    assert apply(T.signature, ["Hàng đẹp quá !!!", "Hàng đẹp quá.", None]) == ["hàngđẹpquá", "hàngđẹpquá", ""]


def test_idempotent(apply):
    raw = ["  A  b c ", "Hàng đẹp quá !!!", "x\n\ny"]
    for fn in (T.signature, T.collapse_ws, T.strip_ws):
        once = apply(fn, raw)
        assert apply(fn, once) == once


def test_junk(apply):
    assert apply(T.is_junk, ["a" * 26, "a" * 25, "a b" + "c" * 40]) == [True, False, False]


def test_urls(apply):
    u = "https://shop.example/products/pdp-i2633384520-s12855671277.html"
    assert apply(T.item_id, [u, "", "https://x/12345", "https://x/1234567"]) == ["2633384520", None, None, "1234567"]
    assert apply(lambda c: T.item_id(c, T.ITEM_ID_SEARCH, missing=""), [None, "x"]) == ["", ""]
    assert apply(T.sku_id, [u, "x"]) == ["12855671277", None]
    assert apply(T.with_scheme, ["//www.x.vn/a", "http://y", None]) == ["https://www.x.vn/a", "http://y", ""]
    assert apply(T.clean_url, [' "http://a" ', "'b'", "“c”"]) == ["http://a", "b", "“c”"]


def test_preview(apply):
    assert apply(T.truncate_text, ["x" * 101, "a\nb", None]) == ["x" * 97 + "...", "a b", ""]


def test_epoch(apply):
    got = apply(T.epoch_ms_to_ts, ["1704067200000", "bad", None])
    assert str(got[0]) == "2024-01-01 00:00:00" and got[1:] == [None, None]
