"""Localities, address candidates and page noise."""

import pytest
from pyspark.sql import functions as F

from opalyx.functions import places

CITIES = [
    ("Alcaldía del Ayuntamiento de Emperador", 'Obra de ejecución de rehabilitación y cambio de uso de edificio de Emperador, en Avenida Barcelona nº 18', "Emperador"),
    ("Município do Porto", "Empreitada de reabilitação da Rua das Flores 12", "Porto"),
    ("Gemeente Amsterdam", "Renovatie van het pand aan Kerkstraat 12", "Amsterdam"),
    ("Oslo kommune", "Utarbeidelse av reguleringsplan, Økern Torgvei 2", "Oslo"),
    ("Helsingin kaupunki", "Peruskorjaus, Heka Ylä-Malmi Markkinatie 16", "Helsingin"),
    ("Suwałki miasto", "Dokumentacja przy ul. Noniewicza 31 w Suwałkach", "Suwałki"),
    ("Oslo kommune v/ Eiendoms- og byfornyelsesetaten", "Utarbeidelse av reguleringsplan, Økern Torgvei 2", "Oslo"),
    ("Gmina Miasto Suwałki", "Dokumentacja projektowa przy ul. Noniewicza 31 w Suwałkach", "Suwałki"),
    ("MINISTRSTVO ZA JAVNO UPRAVO", "Izdelava projektne dokumentacije na naslovu Prešernova cesta 11, Radovljica, z upoštevanjem okoljskih vidikov", "Radovljica"),
    ("Comune di Monte Argentario", "NUOVA ROTATORIA IN PIAZZA AMERIGO VESPUCCI IN PORTO ERCOLE", "Monte Argentario"),
    ("Oslo kommune", "2025/5060 Parallelle rammeavtaler om rådgivende arkitekttjenester (ARK, LARK og IARK)", "Oslo"),
    ("PROVINCIA DI RIMINI", "INCARICO PREVISTO DAL D. LGS. 81/2008", "RIMINI"),
    ("National Platform", "黄山市徽州区2026年老旧小区改造-黄山路片小区改造工程项目-一标段-公开招标公告", "黄山市徽州区"),
    ("National Platform", "三江新区大学城片区03街区011地块M0产业园区建设项目建筑方案及施工图设计招标公告", None),
    ("NANTES MÉTROPOLE HABITAT", "France – Architectural and related services – SAINT HERBLAIN - Chemin de la Solvadière - Mission de maîtrise d'oeuvre", "SAINT HERBLAIN"),
    (None, None, None),
    ("", "in", None),
]


def test_explicit_cities(spark):
    df = spark.createDataFrame([(k, a, t) for k, (a, t, _) in enumerate(CITIES)], "k int, a string, t string")
    got = {r.k: r.c for r in df.select("k", places.explicit_city(F.col("t"), F.col("a")).alias("c")).collect()}
    assert got == {k: c for k, (_, _, c) in enumerate(CITIES)}


def test_labels_of_places(spark):
    labels = {"Investimento 3.3": None, "DIREZIONE LAVORI E CONTABILITA'": None, "Kulttuurin ja vapaa-ajan toimiala, Helsingin": "Helsingin", "Ottawa": "Ottawa", "sul sito weArch.eu": None, "Bell Block Primary School": None, "广东省": None, "": None, "Mirano (VE)": "Mirano"}
    df = spark.createDataFrame([(k,) for k in labels], "t string")
    assert {r.t: r.p for r in df.select("t", places.place_label(F.col("t")).alias("p")).collect()} == labels
    one = spark.range(1).select(places.shown_locality(F.lit("SERVIZIO DEL COMUNE DI MIRANO (VE)."), F.lit("Comune di Mirano"), F.lit("Milano")).alias("a"), places.shown_locality(F.lit("x"), F.lit("Oslo kommune"), F.lit("Oslo Sentrum")).alias("b"), places.shown_locality(F.lit("x"), F.lit("y"), F.lit("Ottawa")).alias("c")).first()
    assert tuple(one) == ("Mirano", "Oslo Sentrum", "Ottawa")


ADDRESSES = [
    ("Contrato de obras en inmueble sito en C/ Mayántigo, Barrio Acorán, Distrito Suroeste de esta localidad", [("street", "C/ Mayántigo", "Barrio Acorán")]),
    ("Affidamento diretto, ai sensi dell'art. 50, c. 1, lett. b), del D.Lgs n. 36/2023 relativo ai lavori in via Vitulanese 104.", [("street_address", "via Vitulanese 104", None), ("street", "via Vitulanese 104", None)]),
    ("realizzazione e sistemazione dei parcheggi a raso nel Campus Bizzozero di Varese, comprensivo dei sistemi", [("site", "Campus Bizzozero di Varese", None)]),
    ("Empreitada de reabilitação do edifício sito na Rua das Flores 12, em Porto.", [("street_address", "Rua das Flores 12", "Porto"), ("street", "Rua das Flores 12", "Porto")]),
    ("Renovatie van het pand aan Kerkstraat 12, Amsterdam.", [("street_address", "Kerkstraat 12", None)]),
    ("Ombyggnad av fastighet på Storgatan 5, Uppsala.", [("street_address", "Storgatan 5", None)]),
    ("Peruskorjaus, Helsinki, Heka Ylä-Malmi Markkinatie 16", [("street_address", "Ylä-Malmi Markkinatie 16", None)]),
    ("Opracowanie dokumentacji projektowej przy ul. Noniewicza 31 w Suwałkach.", [("street_address", "ul. Noniewicza 31", "Suwałkach"), ("street", "ul. Noniewicza 31", "Suwałkach")]),
    ("Preureditev objekta na naslovu Prešernova cesta 11, Radovljica.", [("street_address", "Prešernova cesta 11", None)]),
    ("PROJEKT Prellerweg 47 - 49 12157 Berlin", [("street_address", "Prellerweg 47 - 49", None)]),
    ("lavori della mensa scolastica sede di Magliano Romano in Via Romana 29. Nell'ambito dell'Avviso Pubblico n. 104609", [("street_address", "Via Romana 29", None), ("street", "Via Romana 29", None)]),
    ("edificio scolastico censita al N.C.E.U. al foglio 77 part. 561. Direzione dei lavori.", []),
    ("Via Roma 1 e ancora via Roma 1, Frazione Alta", [("street_address", "Via Roma 1", "Frazione Alta"), ("street", "Via Roma 1", "Frazione Alta")]),
    (None, []),
    ("", []),
]


def test_address_candidates(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(ADDRESSES)], "k int, t string")
    got = {r.k: [tuple(x) for x in r.c] for r in df.select("k", places.address_candidates(F.col("t")).alias("c")).collect()}
    assert got == {k: c for k, (_, c) in enumerate(ADDRESSES)}


NOISE = [
    ("Auftraggeber: Stadt Ulm, ", " Telephone +49 731 161 0, email bau@ulm.example", True),
    ("Subject of the contract: rehabilitation works of the school at ", " The works comprise two floors.", False),
    ("Privacy and cookie terms. ", " News and login", True),
    ("Lageplan Maßstab 1:500 Gemarkung Mitte Architekt ", " öffentlich bestellte", True),
    ("Lavori di realizzazione presso ", ". Contact: ufficio@comune.example", False),
    ("", "", False),
]


def test_noise_on_pages(spark):
    df = spark.createDataFrame([(k, b, a) for k, (b, a, _) in enumerate(NOISE)], "k int, b string, a string")
    got = {r.k: r.n for r in df.select("k", places.page_noise(F.lit("Via Roma 1"), F.col("b"), F.col("a")).alias("n")).collect()}
    assert got == {k: n for k, (_, _, n) in enumerate(NOISE)}
    page = "Lavori di realizzazione presso Via Alta 7. " + "x " * 200 + "Contact: Ufficio tecnico, Via Roma 1, phone 0331 55 66 77"
    kept = spark.range(1).select(places.address_candidates(F.lit(page), places.page_noise).alias("c")).first().c
    assert {x.address for x in kept} == {"Via Alta 7"}
