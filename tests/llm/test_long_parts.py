"""Parts of credentials of any length are found whole."""

import random
import string
import time

import pytest

from tessellar.llm import secrets


def _key(n):
    return "aB1" + "".join(random.Random(n).choices(string.ascii_letters + string.digits, k=n - 3))


def _spans(text):
    return secrets.linked(text, secrets.strong_spans(text), secrets.weak_spans(text))


@pytest.mark.parametrize("n", [20, 27, 28, 128, 129, 200, 342, 5000])
def test_keys_of_any_length(n):
    text = f"user = bob and {_key(n)} here"
    assert _spans(text) == [("identity", 0, 10), ("key", 15, 15 + n)]


def test_endpoints_and_identities_end_where_they_end():
    url, name = "https://db.example.org/" + "p/" * 200, "n" * 300
    text = f"{url} {_key(40)} login={name}"
    assert sorted(_spans(text), key=lambda x: x[1]) == [("endpoint", 0, len(url)), ("key", len(url) + 1, len(url) + 41), ("identity", len(url) + 42, len(text))]


def test_words_are_no_keys():
    assert _spans("user = bob and internationalisation9 or AAAAAAAAAAaaaaaaaaaa1111111111 here") == [] and secrets._key_like("Aa1" * 9) is False


def test_long_runs_take_linear_time():
    text = "user = bob " + "aB1" * 300_000 + "==="
    began = time.time()
    _spans(text)
    assert time.time() - began < 5
