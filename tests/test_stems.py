"""Stemmers against the samples of vocabulary that were published with the algorithms."""

import pytest
from pyspark.sql import functions as F

from lexifold.functions.stems import stem

# fixed values: word and stem
PUBLISHED = {
    "en": """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
    consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
    consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
    conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
    knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
    knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
    knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot generate generat generous generous communication communic skies sky dying die
    news news hopping hop hoping hope hopped hop happy happi cries cri ties tie agreed agre rational ration relational relat electrical electr adjustment adjust herring herring by by say say sayings say""",
    "de": """aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg aufeinanderfolgend aufeinanderfolg aufeinanderfolgende aufeinanderfolg
    aufeinanderfolgenden aufeinanderfolg aufeinanderfolgender aufeinanderfolg aufeinanderfolgt aufeinanderfolgt aufeinanderfolgten aufeinanderfolgt aufeinanderschlage aufeinanderschlag
    aufenthalt aufenthalt aufenthalten aufenthalt aufenthaltes aufenthalt auferlegen auferleg auferlegt auferlegt auferlegten auferlegt auferstand auferstand auferstanden auferstand auferstehen aufersteh
    aufersteht aufersteht auferstehung aufersteh auferstünde auferstund auferwecken auferweck auferweckt auferweckt auferzogen auferzog aufessen aufess auffa auffa auffallen auffall auffallend auffall
    auffallenden auffall auffallender auffall kategorie kategori kategorien kategori kategorisch kategor kategorische kategor kategorischen kategor kategorischer kategor kater kat katerliede katerlied
    katers kat käthchen kathch käthe kath kathedrale kathedral katholik kathol katholiken kathol katholisch kathol katholische kathol katze katz katzen katz kauen kau kauerte kauert kauf kauf kaufe kauf
    kaufen kauf käufer kauf kaufes kauf kaufhaus kaufhaus kaufmann kaufmann kaufmännisch kaufmann kaum kaum kaust kaust kaute kaut kauz kauz""",
    "fr": """continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel continuelle continuel continuellement continuel
    continuelles continuel continuels continuel continuer continu continuera continu continuerait continu continueront continu continuez continu continuité continu continuons continuon
    contorsions contors contour contour contournait contourn contournant contourn contourne contourn contours contour contractait contract contracté contract contractée contract contracter contract
    contractés contract contractions contract contradictoirement contradictoir contradictoires contradictoir contraindre contraindr contraint contraint contrainte contraint contraintes contraint
    contraire contrair contraires contrair contraria contrari main main mains main maintenaient mainten maintenait mainten maintenant mainten maintenir mainten maintenue maintenu maintien maintien
    maintint maintint maire mair maires mair mairie mair mais mais maïs maï maison maison maisons maison maistre maistr maitre maitr maître maîtr maîtres maîtr maîtresse maîtress majesté majest
    majestueuse majestu majestueusement majestu majestueux majestu majeur majeur majeure majeur major major majordome majordom majordomes majordom majorité major majorités major mal mal malacca malacc
    malade malad malades malad maladie malad maladies malad maladive malad""",
    "es": """cheques chequ chetumal chetumal chetumaleños chetumaleñ chevrolet chevrolet chiapaneca chiapanec chiapas chiap chiba chib chic chic chica chic chicago chicag chicana chican chicano chican
    chicas chic chicharrones chicharron chichen chich chichimecas chichimec chicles chicl chico chic chicos chic chihuahua chihuahu chihuahuense chihuahuens chihuahuenses chihuahuens chilaca chilac
    chilena chilen chileno chilen chile chil chimenea chimene china chin torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore
    torero torer toreros torer torio tori tormenta torment tormentas torment tornado torn tornados torn tornar torn tornen torn torneo torne torneos torne tornillo tornill tornillos tornill
    torniquete torniquet torno torn toro tor toronto toront toros tor torpedearon torped torpeza torpez torrado torr torralba torralb torre torr torrencial torrencial torrenciales torrencial
    torrente torrent torreon torreon torreón torreon torres torr torrescano torrescan""",
}


@pytest.mark.parametrize("lang", sorted(PUBLISHED))
def test_published_vocabulary(spark, lang):
    pairs = PUBLISHED[lang].split()
    words, stems = pairs[0::2], pairs[1::2]
    df = spark.createDataFrame([(lang, words)], "lang string, words array<string>")
    got = df.select(stem(F.col("words"), F.col("lang")).alias("s")).first().s
    assert [(w, g) for w, g in zip(words, got)] == list(zip(words, stems))


def test_nulls_and_other_languages(spark):
    df = spark.createDataFrame([("en", None), ("ru", ["cats"]), (None, ["cats"]), ("en", [None, "", "cats"]), ("fr", []), ("de", ["", "a"]), ("es", ["y", ""])], "lang string, words array<string>")
    got = [r.s for r in df.select(stem(F.col("words"), F.col("lang")).alias("s")).collect()]
    assert got == [None, ["cats"], ["cats"], [None, "", "cat"], [], ["", "a"], ["y", ""]]


def test_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("en", ["cats"])], "lang string, words array<string>")
    assert "Python" not in df.select(stem(F.col("words"), F.col("lang")))._jdf.queryExecution().executedPlan().toString()
