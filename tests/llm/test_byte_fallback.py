import sentencepiece
from tokenizers import Tokenizer, models

from marquee.llm import token_counts
from marquee.llm.queries import PIECES


def test_uncovered_characters_cost_their_bytes(spark):
    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(p.id_to_piece(i), float(p.get_score(i))) for i in range(p.get_piece_size()) if not p.is_control(i) and not p.is_unknown(i)]
    assert sum(p.is_byte(i) for i in range(p.get_piece_size())) == 256
    real = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, True))
    texts = ["ሀለሐ", "plain words", "mixed ሀለ word ሐ, end", "🦔🦔 🦔a🦔", "a\x01\x02b", "", "ሀ▁ለ", None, "éß 梦ሀ梦"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.unigram_counts(df, PIECES).collect()}
    for i, t in enumerate(texts):
        assert got[i] == len(real.encode("".join("▁" + w for w in (t or "").split())).ids), t
    assert got[0] == 1 + 9
    pieces = [("▁", -1.0), ("a", -2.0)]
    assert [token_counts.Counter(pieces, x).count("▁ሀለa")[1] for x in (False, True)] == [3, 8]
