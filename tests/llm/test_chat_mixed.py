"""Records that mix forms of content, or have a system text beside their turns, lose no text."""

import json

import pytest

from palimpsest.llm import chat

CASES = [
    ({"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": [{"type": "text", "text": "y"}]}]}, [("user", "x"), ("assistant", "y")]),
    ({"messages": [{"role": "user", "content": [{"text": "a"}, "b", {"type": "image"}, {"text": "c"}]}, {"role": "assistant", "content": "[1, 2]"}]}, [("user", "abc"), ("assistant", "[1, 2]")]),
    ({"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": [{"text": "é\n\"☃"}]}, {"role": "user", "content": ""}]}, [("user", ""), ("assistant", "é\n\"☃"), ("user", "")]),
    ({"messages": [{"role": "user", "content": [{"text": "t"}, "[\"z\"]"]}, {"content": []}]}, [("user", "t[\"z\"]"), ("", "")]),
    ({"system": "be brief", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"text": "a"}]}]}, [("system", "be brief"), ("user", "q"), ("assistant", "a")]),
    ({"system": "be brief", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, [("system", "be brief"), ("user", "q"), ("assistant", "a")]),
    ({"system": "", "messages": [{"role": "user", "content": "q"}]}, [("user", "q")]),
    ({"system": None, "conversations": []}, []),
    ({"system": "alone", "messages": []}, [("system", "alone")]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}]}, [("system", "s"), ("user", "q")]),
]


@pytest.fixture(scope="module")
def mapped(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(CASES)]
    return {r["i"]: r for r in chat.canonical_turns(spark.createDataFrame(rows, "i int, record string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_no_text_is_lost(mapped, i):
    assert [(t["role"], t["text"]) for t in mapped[i]["turns"]] == CASES[i][1]
