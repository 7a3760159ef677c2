import pytest

from lode.operators import models as M
from lode.sources.writers import pdf_bytes


def test_catalogue_and_resolve(spark):
    assert M.catalogue(spark).count() == 7
    assert M.resolve("voyage-3.5-lite") == (1024, "voyage") and M.resolve("nothing") == (384, "local")


def test_clients(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = M.embed_with(rows, lambda texts: [[3.0, 4.0 + len(t)] for t in texts]).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in got)
    with pytest.raises(ValueError):
        M.embed_with(rows, lambda t: t, "other")
    out = {r.id: r for r in M.complete_with(rows, lambda p: p.upper(), "text").collect()}
    assert out[1].completion == "AB" and out[1].completion_error is None and out[2].completion_error.startswith("AttributeError")


def test_pdf_predicates(spark):
    pages = spark.createDataFrame([("a", 1, "", 1), ("a", 2, "x" * 50, 1), ("a", 3, " ", 2), ("b", 1, "", 0), ("a", 4, "x" * 90, 0)], "path string, page_no int, text string, n_images int")
    assert {r.path: r.scanned for r in M.scanned_pdfs(pages).collect()} == {"a": True, "b": False}
    files = spark.createDataFrame([("p", bytearray(pdf_bytes([["x"]], 0, "pw"))), ("q", bytearray(b"%PDF")), ("r", bytearray(pdf_bytes([["/Encrypt"]])))], "path string, content binary")
    assert {r.path: r.encrypted for r in M.encrypted_pdfs(files).collect()} == {"p": True, "q": False, "r": False}


def test_client_factory(monkeypatch):
    monkeypatch.delenv("LODE_API_KEY", raising=False)

    def broken(key):
        raise OSError("no network")

    assert M.client_for(lambda key: key.upper) is None and M.client_for(broken, "k") is None
    assert M.client_for(lambda key: lambda prompt: prompt + key, "k")("p") == "pk"
    monkeypatch.setenv("LODE_API_KEY", "e")
    assert M.client_for(lambda key: lambda prompt: prompt + key)("p") == "pe"
