import pytest
from pyspark.sql import functions as F

from textloom.functions.analysis import STOP_WORDS, analyze, fold, terms
from textloom.functions.porter2 import stem
from textloom.functions.text import terms_col, terms_of

TEXTS = [None, "", "  ", "---", "Straße CAFÉ café", "can't rock’n’jazz 'quoted' dogs'", "a''b c'd 'e' f'", "ΣΊΣΥΦΟΣ ΑΣ", "The engine's engines, trees", "東京タワー x", "İstanbul ﬁne ½ ² Ⅷ", "x" * 5000, "bad̀̀ marks​join"]


def test_columns_agree_with_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for profile in ("plain", "english"):
        got = dict(df.select("i", terms(F.col("text"), profile)).collect())
        assert got == {i: analyze(t, profile) for i, t in enumerate(TEXTS)}
    assert dict(df.select("i", terms_col(F.col("text"))).collect()) == {i: terms_of(t) for i, t in enumerate(TEXTS)}


def test_pins():
    assert analyze("Straße") == ["strass e".replace(" ", "")[:6] + "e"]
    assert analyze("can't rock’n’jazz") == ["can't", "rock'n'jazz"]
    assert analyze("engine's the engines tree's", "english") == ["engin", "engin", "tree"]
    assert analyze("東京タワー") == ["東京タワー"]
    assert fold("café") == "café"
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 127
    with pytest.raises(ValueError):
        analyze("x", "klingon")


@pytest.mark.parametrize(
    "pairs",
    [
        "consign consign consigned consign consistency consist consolatory consolatori conspicuously conspicu knack knack knackeries knackeri knightly knight knots knot kneel kneel",
        "caresses caress ponies poni ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoping hope fitted fit",
        "generate generat generously generous communism communism arsenal arsenal skis ski dying die news news innings inning proceeding proceed",
        "relational relat conditional condit rational ration valenci valenc vietnamization vietnam operator oper feudalism feudal sensibiliti sensibl geology geolog",
        "electriciti electr hopefulness hope goodness good revival reviv allowance allow adjustment adjust adoption adopt rate rate controlling control",
        "by by say say cry cri youth youth enjoy enjoy",
    ],
)
def test_stems(pairs):
    words = pairs.split()
    for word, expected in zip(words[::2], words[1::2], strict=True):
        assert stem(word) == expected, word
