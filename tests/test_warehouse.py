from stratum.functions.scalars import hash_key
from stratum.plans import metrics, specs


def test_specs_are_complete():
    assert (len(specs.STAGING), len(specs.HUBS), len(specs.LINKS), len(specs.SATS)) == (45, 15, 17, 28)


def test_purchase_orders_through_all_layers(spark):
    ekko = spark.createDataFrame([("4500", "1000", "F", "NB", "V1", "O1", "G1", "20240105", "", None, "EUR", 1.0, "me", "20240106", "2", 10.0, "")], "EBELN string, BUKRS string, BSTYP string, BSART string, LIFNR string, EKORG string, EKGRP string, BEDAT string, KDATB string, KDATE string, WAERS string, WKURS double, ERNAM string, AEDAT string, PROCSTAT string, RLWRT double, BANFN string")
    mseg = spark.createDataFrame([("5000", "2024", "0001", "101", "M1", "P1", "L1", 5.0, "EA", "4500", "00010", 9.0, "EUR", "", "V1"), ("5001", "2024", "0001", "201", "M1", "P1", "L1", 1.0, "EA", "", "", 2.0, "EUR", "", "")], "MBLNR string, MJAHR string, ZEILE string, BWART string, MATNR string, WERKS string, LGORT string, MENGE double, MEINS string, EBELN string, EBELP string, DMBTR double, WAERS string, SERNP string, LIFNR string")
    mkpf = spark.createDataFrame([("5000", "2024", "20240110", "20240110", "u", "t", "r")], "MBLNR string, MJAHR string, BUDAT string, BLDAT string, USNAM string, BKTXT string, XBLNR string")
    bkpf = spark.createDataFrame([("1000", "9", "2024", "WE", "20240110", "20240110", "u", "x", "t", "MKPF", "50002024")], "BUKRS string, BELNR string, GJAHR string, BLART string, BUDAT string, BLDAT string, USNAM string, XBLNR string, BKTXT string, AWTYP string, AWKEY string")
    staged = specs.build_staging({"ekko": ekko, "mseg": mseg, "mkpf": mkpf, "bkpf": bkpf}, "2024-02-01 00:00:00")
    assert str(staged["ekko"].first().BEDAT) == "2024-01-05" and staged["ekko"].first().KDATB is None
    hubs, links = specs.build_hubs(staged), specs.build_links(staged)
    assert hubs["hub_purchase_order"].first().purchase_order_number == "4500"
    assert links["link_gr_po"].count() == 1 and links["link_po_vendor"].count() == 1
    assert specs.build_joined_links(staged)["link_gr_accounting"].count() == 1
    sats = specs.build_sats(staged)
    assert sats["sat_po_header"].first().document_type == "NB"
    again = specs.build_hubs(staged, hubs)
    assert again["hub_purchase_order"].count() == 0 and specs.build_sats(staged, sats)["sat_po_header"].count() == 0


def test_item_satellites_hang_on_their_links(spark):
    ekpo = spark.createDataFrame([("4500", "00010", "M1", "text", 5.0, "EA", 2.0, 10.0, "P1", "L1", "G", "0", "", "")], "EBELN string, EBELP string, MATNR string, TXZ01 string, MENGE double, MEINS string, NETPR double, NETWR double, WERKS string, LGORT string, MATKL string, PSTYP string, ELIKZ string, BANFN string")
    mseg = spark.createDataFrame([("5000", "2024", "0001", "101", "M1", "P1", "L1", 5.0, "EA", "4500", "00010", 9.0, "EUR", "", "V1")], "MBLNR string, MJAHR string, ZEILE string, BWART string, MATNR string, WERKS string, LGORT string, MENGE double, MEINS string, EBELN string, EBELP string, DMBTR double, WAERS string, SERNP string, LIFNR string")
    vbap = spark.createDataFrame([("7000", "10", "S1", "plan", "G", 1.0, "EA", 3.0, "P1", "X1")], "VBELN string, POSNR string, MATNR string, ARKTX string, MATKL string, KWMENG double, VRKME string, NETWR double, WERKS string, SERNR string")
    staged = specs.build_staging({"ekpo": ekpo, "mseg": mseg, "vbap": vbap}, "2024-02-01 00:00:00")
    sats, links = specs.build_sats(staged), specs.build_links(staged)
    assert float(sats["sat_po_item"].first().net_value) == 10 and float(sats["sat_gr_item"].first().quantity) == 5 and float(sats["sat_sales_order_item"].first().item_value) == 3
    assert sats["sat_po_item"].join(links["link_po_material"], "hk_po_material").count() == 1 and sats["sat_gr_item"].join(links["link_gr_material"], "hk_gr_material").count() == 1
    assert links["link_po_plant"].first().hk_plant == ekpo.select(hash_key("WERKS")).first()[0]
    assert sats["sat_sales_order_item"].first().hk_so_equipment == vbap.select(hash_key("VBELN", "POSNR", "SERNR")).first()[0]
    assert all(x.count() == 0 for x in specs.build_sats(staged, sats).values())


def test_lifecycle_by_material_group(spark):
    status = ["INST"] * 3 + ["AVLB"] * 14 + ["RET"] * 2 + ["DLFL"]
    frames = {
        "devices": spark.createDataFrame([(i, 1) for i in range(20)] + [(20, 2), (21, None)], "device_id int, material_id int"),
        "device_events": spark.createDataFrame([(i, s, "2024-02-01") for i, s in enumerate(status)] + [(0, "DLFL", "2024-01-01")], "device_id int, status string, status_date string"),
        "materials": spark.createDataFrame([(1, "CPE-RTR"), (2, "X")], "material_id int, material_group string"),
    }
    rows = {r.material_group: r for r in metrics.lifecycle_by_group(frames).collect()}
    r = rows["CPE-RTR"]
    assert (r.equipment_category, r.total_devices, r.deployed, r.in_stock, r.returned, r.defective) == ("Router", 20, 3, 14, 2, 1)
    assert (r.deployment_rate_pct, r.defect_rate_pct, r.return_rate_pct, r.defect_health, r.return_health) == (15.0, 5.0, 10.0, "YELLOW", "YELLOW")
    assert (rows["X"].equipment_category, rows["X"].total_devices, rows["X"].deployed) == ("Other", 1, 0) and rows[None].total_devices == 1
