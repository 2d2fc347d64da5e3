"""The word check of operator 9 in each language that has a reference."""

from __future__ import annotations

import pytest

from curatrix.llm import quality

PROSE = {
    "en": "The committee met in the morning to hear what the engineers had found, and it was clear that the bridge could not be opened for the summer. Of the four piers in the river, two had moved, and the older of them was leaning to the west. The mayor asked for a second report and promised that the town would pay for it. In the afternoon the council voted to keep the road closed.",
    "fr": "Le conseil s'est réuni dans la matinée pour entendre les conclusions des ingénieurs, et il est clair que le pont de la ville ne sera pas ouvert cet été. Sur les quatre piles du fleuve, deux ont bougé et la plus ancienne penche vers un quai. Le maire de la commune demande une seconde étude et promet que les frais des travaux seront payés par la région en fin de saison.",
    "de": "Der Ausschuss traf sich am Morgen, um zu hören, was die Ingenieure gefunden hatten, und es war klar, dass die Brücke im Sommer nicht geöffnet werden konnte. Von den vier Pfeilern im Fluss hatten sich zwei bewegt, und der ältere neigte sich mit einem Riss, der vom Wasser bis zur Fahrbahn reichte, nach Westen. Der Bürgermeister bat um einen zweiten Bericht und versprach, dass die Stadt für die Kosten aufkommen werde.",
    "es": "El consejo se reunió en la mañana para escuchar a los ingenieros, y quedó claro que el puente de la ciudad no se abre en el verano. De los cuatro pilares del río, dos se movieron, y el más antiguo de ellos se inclina por la orilla. La alcaldesa pidió un segundo informe y prometió que las obras de la zona no se pagan con el dinero de los vecinos que viven en el barrio.",
}


@pytest.mark.parametrize("lang", quality.COMMON_WORDS)
def test_texts_without_common_words_are_rejected(spark, lang):
    junk = " ".join(f"z{chr(97 + k % 26)}xu{chr(97 + k // 26)}rn" for k in range(120))
    rows = [(0, PROSE[lang], lang), (1, junk, lang)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[0].kept and got[0].n_words >= quality.COMPARED_WORDS
    assert not got[1].base_failed and got[1].class_distance <= quality.MOST_CLASS_DISTANCE and not got[1].kept
