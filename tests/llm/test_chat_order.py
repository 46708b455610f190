import pytest

from quillforge.llm import chat, packing, queries


def test_windows_out_of_order_fail(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "some words here " * 20) for c in (1, 2) for t in range(12)]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.tokenizer_path("byte_bpe_50k.json"), budget=200, history=50)
    assert {r.n_turns for r in chat.conversation_digests(windows).collect()} == {12}
    with pytest.raises(Exception, match="in order"):
        chat.conversation_digests(windows.repartition(7)).collect()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="only one that drops white space"):
        packing.WordIds(queries.tokenizer_path("byte_bpe_50k.json"))
