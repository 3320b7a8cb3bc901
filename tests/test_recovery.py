"""L4: complete objects of broken JSON text, against a search over all substrings."""

import json
import random

from shelfscope.operators.json_recovery import complete_objects, scan

PIECES = ['{', '}', '[', ']', '"', ':', ',', '"nome_produto"', '"sku_selecionado"', '"x"', '1', '0', 'true', 'null', ' ', '\\',
          '{"nome_produto":"a"}', '{"k":', '{"nome_produto":']


def _object_at(text, start):
    """(value, end) if an object begins at ``start``: tries every closing brace."""
    for end in range(start + 1, len(text) + 1):
        if text[end - 1] == "}":
            try:
                return json.loads(text[start:end]), end
            except ValueError:
                pass
    return None, 0


def _by_substrings(text):
    named, upto = [], 0
    for start, c in enumerate(text):
        if c == "{" and start >= upto:
            value, end = _object_at(text, start)
            if value and any(value.get(k) for k in ("sku_selecionado", "nome_produto")):
                named.append(text[start:end])
                upto = end
    return named


def test_equals_a_search_over_substrings():
    rnd, hits = random.Random(7), 0
    for _ in range(6000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 16)))
        exp = _by_substrings(text)
        assert complete_objects(text) == exp, text
        hits += bool(exp)
    assert hits > 500


def test_strings_with_braces_and_duplicated_keys():
    named = '{"nome_produto":"a } b { \\" c","n":[1,{"z":2.5e3}]}'
    assert complete_objects('lixo } {"w":[' + named + "," + named + ',{"nome_produto":"cortad') == [named, named]
    assert complete_objects('{"nome_produto":"a","nome_produto":""}') == []      # the last of equal keys counts
    assert complete_objects('{"a":"b{"nome_produto":"x"}') == ['{"nome_produto":"x"}']
    assert complete_objects('{"nome_produto":0.0}{"nome_produto":{}}{"nome_produto":[0]}') == ['{"nome_produto":[0]}']
    assert complete_objects('{"nome_produto":"tab\tinside"}') == [] == complete_objects("")


def test_deep_and_long_texts_are_read_once():
    deep = '{"y":' * 60_000 + '{"nome_produto":"fundo"}' + "}" * 59_000
    assert complete_objects(deep) == ['{"nome_produto":"fundo"}']
    spans, end = scan(deep, 0)
    assert len(spans) == 59_001 and end == len(deep)
    assert complete_objects("{" * 300_000) == [] == complete_objects('{"a":"' * 3000)
    many = "[" + ",".join(['{"sku_selecionado":"s","x":{}}'] * 20_000)
    assert len(complete_objects(many)) == 20_000
