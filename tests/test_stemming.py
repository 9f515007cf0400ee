"""The stemmers on the word lists published with them."""

import pytest

from tenderloom.functions import stemming

RUSSIAN = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон вагоны вагон важная важн важнее важн
важнейшие важн важнейшими важн важничал важнича важно важн важного важн важное важн важной важн важном важн важному важн важности важност важностию важност
важность важност важностью важност важную важн важны важн важные важн важный важн важным важн важных важн вазах ваз вазы ваз вакса вакс вакханка вакханк
вал вал валандался валанда валентина валентин валериановых валерианов валерию валер валетами валет
п п па па пава пав павел павел павильон павильон павильонам павильон павла павл павлиний павлин павлиньи павлин павлиньим павлин павлович павлович
павловна павловн павловне павловн павловной павловн павловну павловн павловны павловн павловцы павловц павлыч павлыч павлыча павлыч пагубная пагубн
падает пада падай пада падал пада падала пада падаль падал падать пада падаю пада падают пада падающего пада падающие пада падеж падеж падение паден
падением паден падении паден падений паден падения паден паденье паден паденья паден падет падет падут падут падучая падуч падчерицей падчериц
падчерицы падчериц падшая падш падшей падш падшему падш падший падш падшим падш падших падш падшую падш паек паек
крупы круп гречневые гречнев школы школ""".split()
ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol
consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir
conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight
knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker
knocking knock knocks knock knopp knopp knot knot knots knot
ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope sized size luxuriated luxuri agreed agre feed feed say say by by cry cri
skies sky dying die news news innings inning proceed proceed generate generat generic generic generous generous communism communism communication communic arsenal arsenal
relational relat rational ration analogical analog hopefulness hope electrical electr formalize formal decisively decis adoption adopt roll roll controllable control
rate rate youth youth boyish boyish sayings say office offic papers paper a4 a4 2026 2026 aging age bed bed bedded bed""".split()


@pytest.mark.parametrize("words", [RUSSIAN, ENGLISH])
def test_published_words(spark, words):
    pairs = list(zip(words[::2], words[1::2], strict=True))
    df = spark.createDataFrame(pairs, "word string, want string")
    wrong = df.withColumn("got", stemming.stem(df["word"])).filter("got <> want").collect()
    assert wrong == []


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("ё",), ("y",), ("yyy",), ("sss",), ("ь",), ("ингредиентыing",)], "word string")
    assert [r[0] for r in df.select(stemming.stem(df["word"])).collect()] == [None, "", "ё", "y", "yyy", "sss", "ь", "ингредиентыing"]
