"""Verbs over stores that the build verbs made."""

import json

import pytest

from factloom import cli
from tests.test_sources import GOOD, image, tree  # noqa: F401


def decompile(row):
    return f"int f()\n{{\n  return {row['function']};\n}}\n", "Ok", None, 0.1


def plain(name):
    return name.strip("_")


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    (at / "in").mkdir()
    (at / "in/Reader").write_bytes(image())
    (at / "in/Broken").write_bytes(image()[:40])
    (at / "config.json").write_text(json.dumps(GOOD))
    return at


def said(capsys):
    return capsys.readouterr().out


def test_builds_and_verbs(spark, stores, tree, capsys):  # noqa: F811
    store, code, docs, config = (str(stores / n) for n in ("store", "code", "docs", "config.json"))
    assert cli.main(["build", "facts", "--images-dir", str(stores / "in"), "--store", store, "--demangle", "tests.test_cli:plain", "--json"], spark) == 1
    built = json.loads(said(capsys))
    assert (built["built"], built["failed"]) == (1, 1) and built["images"][0].endswith("/Reader") and built["failures"][0]["image"].endswith("/Broken") and built["peak_mib"] > 0
    functions = spark.read.parquet(f"{store}/{spark.read.text(f'{store}/current').first()[0]}/function")
    functions.selectExpr("image_id", "address AS function", "size AS bytes", "cast(NULL AS string) AS tower", "'n' AS name").write.parquet(str(stores / "work"))
    assert cli.main(["build", "pseudocode", "--work", str(stores / "work"), "--code", code, "--hook", "tests.test_cli:decompile"], spark) == 0
    assert "FOUND 2  coverage 2/2" in said(capsys)
    assert cli.main(["build", "docs", "--root", str(tree), "--config", config, "--documents", docs], spark) == 0
    assert "FOUND 3  coverage 4/4" in said(capsys)
    where = ["--store", store, "--documents", docs, "--code", code, "--config", config, "--root", str(tree)]
    assert cli.main(["callers", "0x100c", *where], spark) == 0
    assert "0x1004  in 0x1004  Reader  Unresolved" in said(capsys)
    assert cli.main(["fn", "0x1005", "--asm", *where], spark) == 0
    out = said(capsys)
    assert "facts: 1 images, coverage 2/2" in out and "0x1004  bl #0x100c" in out and "layer 1: 1/1 instruction words decoded" in out
    assert cli.main(["fn", "0x1004", *where], spark) == 0
    assert "return 4100;" in said(capsys)
    assert cli.main(["grep", "return", *where], spark) == 0
    assert "Reader 0x1004:3:   return 4100;" in said(capsys)
    assert cli.main(["grep", "return", "--limit", "0", "--json", *where], spark) == 0
    assert any("return 4100" in x for x in json.loads(said(capsys))["output"])
    assert cli.main(["q", "main", *where], spark) == 0
    assert "owner: " in said(capsys)
    assert cli.main(["find", "first", *where], spark) == 0
    assert "docs/re/one.md 1 First" in said(capsys)
    assert cli.main(["laudo", "one", "1.1", *where], spark) == 0
    assert "verdict" not in said(capsys)
    assert cli.main(["laudo", "none", *where], spark) == 0
    assert "EMPTY  coverage 4/4" in said(capsys)
    assert cli.main(["status", *where], spark) == 0
    out = said(capsys)
    assert "SchemaVersion: 2" in out and "changed: 0, added: 0, removed: 0" in out and "store: " in out
    (tree / "docs/re/one.md").write_text("# 1 First\nchanged and longer than before, by some words\n")
    assert cli.main(["find", "first", *where], spark) == 0
    assert "[stale]" in said(capsys)
    assert cli.main(["laudo", "one", "1", *where], spark) == 2
    assert "NOT VERIFIED" in said(capsys)


def test_refusals(spark, stores, capsys):
    assert cli.main(["callers", "0x1", "--store", str(stores / "nothing")], spark) == 2
    assert "NOT VERIFIED" in said(capsys)
    assert cli.main(["build", "facts", "--images-dir", str(stores / "in"), "--store", "x", "--demangle", "no.such:hook"], spark) == 2
    assert cli.main(["build", "nothing"], spark) == 2 and cli.main(["callers", "0x1"], spark) == 2 and cli.main(["--version"], spark) == 0


def test_chosen_images(spark, stores, tmp_path, capsys):
    """Names and tower maps choose images; a later build that fails keeps what was done."""
    (tmp_path / "in").mkdir()
    for name in ("Reader", "Sample", "Other"):
        (tmp_path / "in" / name).write_bytes(image())
    (tmp_path / "towers.json").write_text(json.dumps({"build": "x", "image": {"/lib/Sample": "top", "/lib/Empty": ""}, "indexed_non_tower_image": {"/lib/Reader": "side"}}))
    store = str(tmp_path / "store")
    build = ["build", "facts", "--images-dir", str(tmp_path / "in"), "--store", store]
    assert cli.main([*build, "--towers", str(tmp_path / "towers.json")], spark) == 0
    assert "FOUND 2  coverage 4/4" in said(capsys)
    where = f"{store}/{spark.read.text(f'{store}/current').first()[0]}/image"
    assert {(r["path"].rsplit("/", 1)[-1], r["tower"]) for r in spark.read.parquet(where).collect()} == {("Sample", "top"), ("Reader", "side")}
    (tmp_path / "in/Sample").write_bytes(image()[:40])
    assert cli.main([*build, "--images", "Sample,Other"], spark) == 0  # the failure over a usable image records nothing
    assert "FOUND 2  coverage 4/4" in said(capsys)
