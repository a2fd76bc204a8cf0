"""Operator 3: benchmark items too short for edits."""

import pytest

from spanframe.llm import decontaminate


@pytest.mark.parametrize("item, text, found", [
    ("Paris", "The answer is PARIS.", True), ("Paris", "paris", True), ("Paris", "comparison", False), ("Paris", "Parish", False), ("Paris", "a parish of Paris", True),
    ("what is 2 + 2?", "Q: What  is\n2 + 2? A: 4", True), ("what is 2 + 2?", "what is 2 + 3?", False), ("c++", "in C++20", True), ("c++", "abc++", False), ("4", "1, 4", True), ("4", "14", False),
])
def test_short_items_match_whole_words(spark, item, text, found):
    block, = decontaminate.blocks(spark.createDataFrame([(7, item), (8, " "), (9, None)], "item_id long, text string"))
    normal = decontaminate.normal(text)
    hits = decontaminate.Finder(block).hits(normal)
    assert [(i, edits, normal[end - len(block[i][1]) : end]) for i, edits, end in hits] == ([(0, 0, block[0][1])] if found else [])
