import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("wordloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wordloom-tests-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


SENTENCES = {
    "en": [
        "the weather in the north was cold and the rain would not stop for days",
        "she walked through the garden and looked at the flowers near the house",
        "they have been working on this question since the beginning of the year",
        "there is nothing better than a good book and a cup of tea in the evening",
    ],
    "fr": [
        "le temps dans le nord était froid et la pluie ne voulait pas cesser",
        "elle marchait dans le jardin et regardait les fleurs devant la maison",
        "ils travaillent sur cette question depuis le début de cette année",
        "il n'y a rien de mieux qu'un bon livre et une tasse de thé le soir",
    ],
    "tr": [
        "kuzeyde hava çok soğuktu ve yağmur günlerce durmak bilmedi",
        "bahçede yürüdü ve evin önündeki çiçeklere uzun uzun baktı",
        "bu soru üzerinde yılın başından beri hep birlikte çalışıyorlar",
        "akşamları iyi bir kitap ve bir bardak çaydan daha güzel bir şey yoktur",
    ],
}


@pytest.fixture(scope="session")
def sentences(spark):
    rows = [(f"{lang}{i}", text, lang) for lang, texts in SENTENCES.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, text string, lang string")


@pytest.fixture(scope="session")
def profiles(sentences):
    from wordloom.operators.language import language_profiles
    from wordloom.sources.scratch import materialise

    return materialise(language_profiles(sentences, "text", "lang"), "test-profiles")
