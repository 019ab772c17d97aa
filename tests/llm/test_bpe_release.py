"""An encoding task gives its vocabulary and memories back when its rows are handed on."""
import inspect

import public_tokenizers

from intake_spark.llm import bpe


def test_release_forgets_the_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = bpe.load(path)
    assert bpe.load(path) is first and bpe.load.cache_info().currsize == 1
    bpe.release()
    assert bpe.load.cache_info().currsize == 0 and "release()" in inspect.getsource(bpe.coded)
