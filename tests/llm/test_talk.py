"""Quotation and talk are told from notices by their form, whatever the sentence is about."""

import pytest

from seriesloom.llm import residue

NOTICES = [
    "The portal is temporarily offline.", "Something went wrong, please contact the clerk.", "503 Service Unavailable The clerk of the committee spoke first.", "The page you requested on the land register was moved.",
    "Please enable JavaScript to read page nine.", '"Please enable JavaScript to continue"', "Sorry, something went wrong at the counter.", "Das Portal: Interner Serverfehler.",
]
TALK = [
    '"Please enable JavaScript to continue", the kiosk told the baker.', "Im Vertrag steht »Text folgt«, wo der Preis stehen müsste.", "The treaty now reads “text to follow” under the heading of fisheries.",
    "Le contrat porte « erreur interne du serveur » au lieu du prix.", "El folleto del museo tenía texto de relleno, como admitió el director.", "The museum told us that an error occurred during the night.", "The leaflet contained dummy text on every sheet.",
]


@pytest.mark.parametrize("text", NOTICES)
def test_notices_near_parliamentary_words_are_seen(text):
    assert any(residue.spans(s) for s in residue.sentences(text))


@pytest.mark.parametrize("text", TALK)
def test_talk_with_other_nouns_is_not(text):
    assert not any(residue.spans(s) for s in residue.sentences(text))
