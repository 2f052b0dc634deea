import json

import pytest

from factloom import cli
from factloom.plans import answers
from factloom.plans.catalogue import CALLED
from factloom.plans.verdict import EMPTY, FOUND, NOT_VERIFIED, PARTIAL
from factloom.sources.projection import BASE, DATA, STEP, Projection


@pytest.fixture(scope="module")
def facts(spark):
    return answers.Facts.projected(Projection(spark, "/root/testdata/sf0.01"))


def test_counts_do_not_depend_on_the_cap(facts):
    one, two = answers.callers(facts, CALLED), answers.callers(facts, CALLED, full=True)
    assert one.verdict.kind == FOUND and one.verdict.count == two.verdict.count == len(two.output) and len(one.output) == min(10, one.verdict.count)


def test_refusals_are_no_zeros(facts):
    assert answers.calls(facts, 0x10).verdict.kind == NOT_VERIFIED
    assert answers.calls(facts, BASE + 4).verdict.why.endswith("not a function start")
    assert answers.calls(facts, BASE + 6 * 256000).verdict.kind == PARTIAL  # image 6 failed
    empty = answers.callers(facts, BASE + 1).verdict
    assert empty.kind == EMPTY and empty.effective == PARTIAL and empty.exit_code == 3
    assert answers.search(facts, "").verdict.kind == answers.search(facts, "x", ["no such image"]).verdict.kind == NOT_VERIFIED
    assert answers.find(facts, "ab").verdict.kind == answers.find(facts, "a-bcd").verdict.kind == NOT_VERIFIED


def test_verbs(facts):
    assert answers.calls(facts, BASE + 42 * STEP).verdict.kind == FOUND
    assert answers.refs(facts, DATA, DATA + 4000).verdict.count > 0
    code = answers.fn(facts, BASE + 5)
    assert code.verdict.kind == FOUND and code.output[0].startswith("0x180000005 is in 0x180000000 (+0x5), 256 bytes")
    assert any(x.startswith("islands: ") for x in code.output)
    assert answers.laudo(facts, "conv-3").verdict.total == answers.find(facts, "thing").verdict.total > 1
    assert answers.question(facts, hex(CALLED)).verdict.kind == FOUND
    assert answers.question(facts, "no such symbol").verdict.kind == EMPTY
    assert answers.laudo(facts, "conv-3").verdict.count > 0 and answers.laudo(facts, "conv-3", "§1").verdict.count == 1
    for absent in (answers.laudo(facts, "nothing").verdict, answers.find(facts, "qqqqzzzz").verdict):  # not all documents were read
        assert absent.kind == EMPTY and absent.effective == PARTIAL and absent.exit_code == 3 and absent.read < absent.total
    assert answers.status(facts).verdict.kind == FOUND
    site = facts.virtual_call.agg({"site": "min"}).first()[0]
    assert answers.vcall(facts, site).verdict.count > 0


def test_command_line(spark, capsys):
    assert cli.main(["callers", hex(CALLED), "--tables", "/root/testdata/sf0.001", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["verdict"] == FOUND
    assert cli.main(["callers", "zz", "--tables", "x"], spark) == 2 and cli.main(["nonsense"], spark) == 2 and cli.main(["q", "x", "--unknown"], spark) == 2


def test_search_says_what_it_did_not_reach(facts):
    stopped = answers.search(facts, "the", limit=3)
    assert stopped.verdict.count == 3 and stopped.verdict.read < stopped.verdict.total
    text = "\n".join(stopped.output)
    assert "stopped at 3 hit(s)" in text and "not reached: " in text
    whole = answers.search(facts, "the", limit=0)
    lines = list(whole.stream)
    assert len(lines) == whole.verdict.count > 3 and lines[:3] == stopped.output[:3] and "not reached" not in "\n".join(whole.output)
    assert "not searched: " in "\n".join(whole.output) and whole.verdict.read < whole.verdict.total
    assert "partial: " in "\n".join(answers.search(facts, "qqqqzzzz").output + whole.output)
    refused = answers.search(facts, "x", ["no such image"]).verdict.why
    assert "unknown images: no such image; known are " in refused


def test_instructions_of_a_function(facts):
    out = answers.fn(facts, BASE, asm=True)
    assert out.verdict.kind == FOUND and out.output[-1].startswith("layer 1: ") and out.verdict.total == 64
    assert answers.fn(answers.Facts(**{**facts.__dict__, "instruction": None}), BASE, asm=True).verdict.kind == NOT_VERIFIED


def test_unreadable_documents(facts):
    """Unread documents are said to be so in their block; the rest of the answer stands. Absent ones are not built."""
    unread = answers.Facts(**{**facts.__dict__, "section": None, "citation": None, "documents_problem": "Io read table"})
    out = answers.question(unread, hex(CALLED))
    assert out.verdict.kind == FOUND and "documents: NOT VERIFIED Io read table" in out.output
    assert answers.find(unread, "thing").verdict.why == answers.laudo(unread, "x").verdict.why == "Io read table"
    absent = answers.Facts(**{**facts.__dict__, "section": None, "citation": None})
    assert "documents: not built" in answers.question(absent, hex(CALLED)).output and answers.find(absent, "thing").verdict.kind == NOT_VERIFIED
