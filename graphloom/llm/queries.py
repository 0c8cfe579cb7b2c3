"""The registered queries of this subpackage; each calls its operator with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers

from graphloom.llm import ann, byte_bpe, gif, html_text, minhash, ngram, oracles, packing, substring, token_files, toxicity
from graphloom.llm.common import table


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_token_files(spark, sf_dir):
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


def op5_substring(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents"), n=35, text=False)


def op6_lm_scores(spark, sf_dir):
    return ngram.lm_scores(table(spark, sf_dir, "documents"))


def op7_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)


def op9_gif(spark, sf_dir):
    return gif.media_digest(table(spark, sf_dir, "documents"))


def op10_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash, op3_token_files, op4_byte_bpe, op5_substring, op6_lm_scores, op7_ann, op8_packing, op9_gif, op10_html_text)}
ORACLE_SQL: dict[str, str] = {"op2_minhash": oracles.MINHASH, "op5_substring": oracles.SUBSTRING, "op10_html_text": oracles.HTML}
