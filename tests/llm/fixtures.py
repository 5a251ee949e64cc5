"""Small document tables with the odd rows every operator has to stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_rows():
    long = " ".join(WORDS[(i * i + i // 7) % 20] for i in range(3000))
    texts = [
        None, "", " ", "a", "the same text", "the same text", "tail  spaces  \n\n x\ty ", "été naïve Ünïcode ß 漢字 😀 don't it's",
        long, long + " end", "\xa0 x\u2003 y\x1cz", "<|endoftext|> is text", "x" * 5000, "the same text", "1 22 333, 4.5!",
    ]
    rows = [(i, t, "en", "s", None, 7, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id", None, None, None, None, None), (900, "the same text", "en", "s", 3, 1, "x")]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
