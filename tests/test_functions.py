import pytest

from recollect.functions import stem, texts, words

# From the published vocabulary of the algorithm.
PUBLISHED = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist",
    "consolation": "consol", "consolatory": "consolatori", "console": "consol", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneaded": "knead",
    "kneeling": "kneel", "knightly": "knight", "knives": "knive", "skis": "ski", "dying": "die", "news": "news",
}


@pytest.mark.parametrize(("word", "want"), PUBLISHED.items())
def test_stems(word, want):
    assert stem.stem(word) == want


def test_words_that_are_not_stemmed():
    assert stem.stem("as") == "as" and stem.stem("left-handed") == "left-handed"


def test_word_lists():
    assert len(words.SEARCH_STOPS) == 172 and "can" not in words.SEARCH_STOPS and "youve" in words.SEARCH_STOPS


def test_splitting():
    text = "one two three\n\nfour five\nsix seven eight nine ten"
    for most in (4, 10, 25):
        pieces = texts.split_recursive(text, most)
        assert all(len(p) <= most for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())
    assert texts.split_recursive("", 5) == [] and texts.split_recursive("abcdef", 4) == ["abcd", "ef"]


def test_sections():
    text = "before\n# One\na b\n  ## Two \nc\n#no\n### Three\nd"
    assert texts.sections(text) == [("One", "# One\na b\n"), ("Two", "  ## Two \nc\n#no\n"), ("Three", "### Three\nd")] and texts.sections("x") == [("Document Root", "x")]
    assert texts.grouped_sections(text, tokens=9) == [("One - Two", "# One\na b\n  ## Two \nc\n#no\n"), ("Three", "### Three\nd")]
    assert texts.windows("a b c d e f g", 4, 1) == ["a b c d", "d e f g"] and texts.windows("a b c d e", 4, 1) == ["a b c d", "d e"] and texts.windows(" ", 4, 1) == []
    assert [t for t, _ in texts.grouped_sections("# L\n" + "w " * 30, tokens=20, overlap=2)] == ["L (Part 1)", "L (Part 2)"]


def test_compaction():
    text = "avoid x\n**Why**: " + "because " * 50 + "\n**Prescribed Remedy**: do y"
    assert texts.compacted(text, 40) == "avoid x\n**Prescribed Remedy**: do y"
    assert texts.compacted("a b", 100) == "a b" and texts.compacted("long " * 50, 5) is None
    parts = "one two three\n\n" + "four " * 40 + "\n\nfive"
    assert texts.compacted(parts, 40) == "one two three\n\n" + texts.CUT
    cut = texts.compacted("word " * 100, 60)
    assert texts.token_estimate(cut) <= 60 and cut.endswith(texts.CUT) and texts.token_estimate("word " * 100) > 60


def test_small_functions():
    assert texts.token_estimate("hello world") == 2 + 1 + 2 and texts.token_estimate("a::b") == 3 and texts.token_estimate("getHTTPName_x") == 1 + 3 + 1 + 1
    assert "+c" in texts.sequence_diff(["a"], ["a", "c"])
    assert texts.flat(["a", {"text": "b", "content": [{"text": "c"}], "input": "d"}, 3]) == "a\nb\nc\nd" and texts.flat({"content": "x"}) == "x" and texts.flat(None) == ""
    assert texts.members({"a": None, "b": [None, {"c": None}]}) == {"b": [None, {}]}
