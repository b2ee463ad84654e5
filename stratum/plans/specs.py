"""Warehouse specifications as plain text: staging, hubs, links and satellites."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalars import hash_key
from stratum.operators.vault import HubSpec, LinkSpec, SatSpec, StagingSpec, load_hub, load_link, load_sat, stage

# Names of source columns and what they are called.
# table | record source | hash keys (name=columns) | text dates | casts | change-hash columns
STAGING_TEXT = """
bkpf | SAP_FI_BKPF | accounting_document=BELNR,GJAHR,BUKRS | BUDAT,BLDAT |  | BLART,BUDAT,BLDAT,USNAM,XBLNR,BKTXT,AWTYP,AWKEY
bseg | SAP_FI_BSEG | accounting_document=BELNR,GJAHR,BUKRS;material=MATNR |  | DMBTR=decimal(13,2);WRBTR=decimal(13,2) | BSCHL,HKONT,DMBTR,WRBTR,SHKZG,WAERS,MATNR,WERKS
eban | SAP_MM_EBAN | purchase_requisition=BANFN;material=MATNR;plant=WERKS | BADAT,FRGDT | MENGE=decimal(13,3);PREIS=decimal(11,2) | MATNR,WERKS,LGORT,MENGE,MEINS,PREIS,STATU,ESTKZ,EKGRP,EKORG
ebkn | SAP_MM_EBKN | purchase_requisition=BANFN |  |  | SAKTO,KOSTL
ekbe | SAP_MM_EKBE | purchase_order=EBELN;material_document=BELNR,GJAHR | BUDAT | MENGE=decimal(13,3);DMBTR=decimal(13,2) | VGABE,BUDAT,MENGE,DMBTR,WAERS,BWART
eket | SAP_MM_EKET | purchase_order=EBELN;po_item=EBELN,EBELP | EINDT | MENGE=decimal(13,3);WEMNG=decimal(13,3) | EINDT,MENGE,WEMNG
ekkn | SAP_MM_EKKN | purchase_order=EBELN;po_item=EBELN,EBELP |  |  | SAKTO,KOSTL
ekko | SAP_MM_EKKO | purchase_order=EBELN;vendor=LIFNR | BEDAT,KDATB,KDATE,AEDAT | WKURS=decimal(9,5);RLWRT=decimal(15,2) | BUKRS,BSTYP,BSART,LIFNR,EKORG,EKGRP,BEDAT,WAERS,WKURS,PROCSTAT,RLWRT,BANFN
ekpo | SAP_MM_EKPO | purchase_order=EBELN;po_item=EBELN,EBELP;material=MATNR |  | MENGE=decimal(13,3);NETPR=decimal(11,2);NETWR=decimal(13,2) | TXZ01,MENGE,MEINS,NETPR,NETWR,WERKS,LGORT,MATKL,PSTYP,ELIKZ
eqbs | SAP_PM_EQBS | equipment=EQUNR | BEGDT |  | USTXT,STAT_DESC
equi | SAP_PM_EQUI | equipment=EQUNR;material=MATNR | INBDT,ERDAT |  | SERGE,HERST,TYPBZ,INBDT,GEWRK,EQART,STAT_TEXT
kna1 | SAP_SD_KNA1 | customer=KUNNR | ERDAT |  | NAME1,LAND1,ORT01,STRAS,PSTLZ,KTOKD
lfa1 | SAP_MM_LFA1 | vendor=LIFNR | ERDAT |  | NAME1,LAND1,ORT01,STRAS,TELF1,ADRNR
lfb1 | SAP_MM_LFB1 | vendor=LIFNR |  |  | ZTERM,AKONT,ZWELS,FDGRV
lfm1 | SAP_MM_LFM1 | vendor=LIFNR |  |  | WAERS,ZTERM,WEBRE,LEBRE
makt | SAP_MM_MAKT | material=MATNR |  |  | MAKTX
mara | SAP_MM_MARA | material=MATNR | ERDAT | BRGEW=decimal(13,3) | MTART,MATKL,MEINS,BRGEW,GEWEI,MSTAE,SPART,PRDHA
marc | SAP_MM_MARC | material=MATNR;plant=WERKS;material_plant=MATNR,WERKS |  |  | DISMM,DISPO,EKGRP,BESKZ,SOBSL,LGPRO,PLIFZ,SERNP
mard | SAP_MM_MARD | material=MATNR;plant=WERKS;stock_location=MATNR,WERKS,LGORT |  | LABST=decimal(13,3);INSME=decimal(13,3);SPEME=decimal(13,3) | LABST,INSME,SPEME
marm | SAP_MM_MARM | material=MATNR |  | UMREZ=int;UMREN=int | MEINH,UMREZ,UMREN
mkpf | SAP_MM_MKPF | material_document=MBLNR,MJAHR | BUDAT,BLDAT |  | BUDAT,BLDAT,USNAM,BKTXT,XBLNR
mseg | SAP_MM_MSEG | material_document=MBLNR,MJAHR;material=MATNR;plant=WERKS;purchase_order=EBELN |  | MENGE=decimal(13,3);DMBTR=decimal(13,2) | BWART,MATNR,WERKS,LGORT,MENGE,MEINS,DMBTR,WAERS,SERNP,LIFNR
objk | SAP_PM_OBJK | equipment=EQUNR;material=MATNR |  |  | OBTYP,OBJNR,MATNR,SERNR,TASER
rbkp | SAP_MM_RBKP | invoice=BELNR,GJAHR;vendor=LIFNR;purchase_order=EBELN | BLDAT,BUDAT | RMWWR=decimal(13,2) | BLDAT,BUDAT,LIFNR,WAERS,RMWWR,XBLNR,EBELN
resb | SAP_MM_RESB | reservation=RSNUM;material=MATNR;plant=WERKS | BDTER | BDMNG=decimal(13,3) | MATNR,WERKS,LGORT,BDMNG,MEINS,BDTER
rkpf | SAP_MM_RKPF | reservation=RSNUM | RSDAT |  | RSDAT,USNAM,BKTXT
rseg | SAP_MM_RSEG | invoice=BELNR,GJAHR;purchase_order=EBELN;material=MATNR |  | MENGE=decimal(13,3);WRBTR=decimal(13,2) | EBELN,EBELP,MATNR,MENGE,WRBTR,WAERS
ser01 | SAP_MM_SER01 | purchase_order=EBELN;material=MATNR |  | MENGE=decimal(13,3) | SDESSION_TYPE,EBELN,EBELP,MATNR,MENGE
ser03 | SAP_MM_SER03 | material_document=MBLNR;material=MATNR |  | MENGE=decimal(13,3) | SDESSION_TYPE,MBLNR,ZEILE,MATNR,MENGE
seri | SAP_MM_SERI | equipment=EQUNR;material=MATNR |  |  | MBLNR,ZEILE,SERNR,MATNR
t001 | SAP_FI_T001 | company_code=BUKRS |  |  | 
t001l | SAP_MM_T001L | storage_location=WERKS,LGORT;plant=WERKS |  |  | 
t001w | SAP_MM_T001W | plant=WERKS |  |  | 
t023 | SAP_MM_T023 |  |  |  | 
t024 | SAP_MM_T024 |  |  |  | 
t024e | SAP_MM_T024E |  |  |  | 
t156 | SAP_MM_T156 | movement_type=BWART |  |  | BWARK,KZBEW,SHKZG
t156t | SAP_MM_T156T | movement_type=BWART |  |  | BTEXT,LTEXT
vbak | SAP_SD_VBAK | sales_order=VBELN;customer=KUNNR | ERDAT,AUDAT | NETWR=decimal(15,2) | AUDAT,AUART,VKORG,VTWEG,SPART,KUNNR,NETWR,WAERK
vbap | SAP_SD_VBAP | sales_order=VBELN;sales_order_item=VBELN,POSNR;service_plan=MATNR |  | KWMENG=decimal(13,3);NETWR=decimal(15,2) | MATNR,ARKTX,MATKL,KWMENG,VRKME,NETWR,WERKS,SERNR
vbrk | SAP_SD_VBRK | billing_doc=VBELN;customer=KUNRG | FKDAT,ERDAT | NETWR=decimal(15,2);MWSBK=decimal(15,2) | FKART,VBTYP,FKDAT,KUNRG,KUNAG,NETWR,MWSBK,WAERK,VKORG,FKSTO,BUKRS
vbrp | SAP_SD_VBRP | billing_doc=VBELN;billing_item=VBELN,POSNR;service_plan=MATNR;sales_order=AUBEL | PRSDT | FKIMG=decimal(13,3);NETWR=decimal(15,2) | FKIMG,VRKME,NETWR,MATNR,ARKTX,MATKL,WERKS,AUBEL,AUPOS,PRSDT
zmm_approval_log | SAP_MM_ZMM_APPROVAL_LOG | zmm_approval=APPROVAL_ID;purchase_order=EBELN;invoice=BELNR,GJAHR |  | TOL_AMT=decimal(13,2) | APPR_STATUS,APPR_DATE,APPR_USER,REASON_CODE,TOL_AMT,SGTXT,EBELN,EBELP,BELNR,GJAHR
zmm_material_business | SAP_MM_ZMM_MATERIAL_BUSINESS | material=MATNR |  | LIFECYCLE_MONTHS=int | LIFECYCLE_MONTHS,PRIMARY_VENDOR_ID,NOTES
zmm_vendor_business | SAP_MM_ZMM_VENDOR_BUSINESS | vendor=LIFNR |  |  | EQUIPMENT_TYPES,CONTRACT_STATUS,QUALITY_RATING,NOTES
"""
# hub | key | business key (column=name) | staged table
HUBS_TEXT = """
hub_accounting_document | hk_accounting_document | BELNR=accounting_document_number,GJAHR=fiscal_year,BUKRS=company_code | bkpf
hub_billing_document | hk_billing_doc | VBELN=billing_document_number | vbrk
hub_customer | hk_customer | KUNNR=customer_id | kna1
hub_equipment | hk_equipment | EQUNR=equipment_number | equi
hub_invoice | hk_invoice | BELNR=invoice_number,GJAHR=fiscal_year | rbkp
hub_material | hk_material | MATNR=material_number | mara
hub_material_document | hk_material_document | MBLNR=material_document_number,MJAHR=fiscal_year | mkpf
hub_movement_type | hk_movement_type | BWART=movement_type | t156
hub_plant | hk_plant | WERKS=plant_code | t001w
hub_purchase_order | hk_purchase_order | EBELN=purchase_order_number | ekko
hub_purchase_requisition | hk_purchase_requisition | BANFN=requisition_number | eban
hub_sales_order | hk_sales_order | VBELN=sales_order_number | vbak
hub_service_plan | hk_service_plan | MATNR=service_plan_id | vbap
hub_vendor | hk_vendor | LIFNR=vendor_id | lfa1
hub_zmm_approval | hk_zmm_approval | APPROVAL_ID=approval_id | zmm_approval_log
"""
# link | own key | its columns (empty: staged) | other keys | staged tables and their join | filter
LINKS_TEXT = """
link_billing_accounting | hk_billing_accounting | v.VBELN,b.BELNR,b.GJAHR,b.BUKRS | hk_billing_doc,hk_accounting_document | bkpf, vbrk ON b.AWKEY = v.VBELN ‖ CAST(YEAR(v.FKDAT) AS VARCHAR) | b.BLART = 'RV'
link_billing_customer | hk_billing_customer | VBELN,KUNRG | hk_billing_doc,hk_customer | vbrk | 
link_billing_sales_order | hk_billing_sales_order | VBELN,AUBEL | hk_billing_doc,hk_sales_order | vbrp | AUBEL IS NOT NULL AND AUBEL != ''
link_equipment_gr | hk_equipment_gr | s.EQUNR,s.MBLNR,m.MJAHR | hk_equipment,hk_material_document | seri, mkpf ON m.MBLNR = s.MBLNR | s.EQUNR IS NOT NULL AND s.EQUNR != ''
link_equipment_material | hk_equipment_material | EQUNR,MATNR | hk_equipment,hk_material | equi | 
link_gr_accounting | hk_gr_accounting | m.MBLNR,m.MJAHR,b.BELNR,b.BUKRS | hk_material_document,hk_accounting_document | bkpf, mkpf ON b.AWKEY = m.MBLNR ‖ m.MJAHR | b.BLART = 'WE'
link_gr_material | hk_gr_material | MBLNR,MJAHR,MATNR | hk_material_document,hk_material | mseg | 
link_gr_po | hk_gr_po | MBLNR,MJAHR,EBELN | hk_material_document,hk_purchase_order | mseg | EBELN IS NOT NULL AND EBELN != ''
link_invoice_accounting | hk_invoice_accounting | r.BELNR,r.GJAHR,b.BELNR,b.BUKRS | hk_invoice,hk_accounting_document | bkpf, rbkp ON b.AWKEY = r.BELNR ‖ r.GJAHR | b.BLART = 'RE'
link_invoice_po | hk_invoice_po | BELNR,GJAHR,EBELN | hk_invoice,hk_purchase_order | rbkp | EBELN IS NOT NULL AND EBELN != ''
link_po_item | hk_po_item |  | hk_purchase_order | ekpo | 
link_po_material | hk_po_material | EBELN,EBELP,MATNR | hk_purchase_order,hk_material | ekpo | 
link_po_plant | hk_po_plant | EBELN,WERKS | hk_purchase_order,hk_plant | ekpo | 
link_po_vendor | hk_po_vendor | EBELN,LIFNR | hk_purchase_order,hk_vendor | ekko | 
link_pr_po | hk_pr_po | BANFN,EBELN | hk_purchase_requisition,hk_purchase_order | ekpo | BANFN IS NOT NULL AND BANFN != ''
link_sales_order_customer | hk_sales_order_customer | VBELN,KUNNR | hk_sales_order,hk_customer | vbak | 
link_sales_order_equipment | hk_so_equipment | p.VBELN,p.POSNR,p.SERNR | hk_sales_order,hk_sales_order_item,hk_equipment,hk_material | vbap, equi ON p.SERNR = e.SERGE | 
"""
# satellite | parent key | child keys | staged table | filter | distinct | payload (column=name)
SATS_TEXT = """
sat_accounting_header | hk_accounting_document |  | bkpf |  |  | BLART=document_type,BUDAT=posting_date,BLDAT=document_date,USNAM=posted_by,XBLNR=reference,AWTYP=reference_transaction,AWKEY=reference_key
sat_billing_document | hk_billing_doc |  | vbrk |  |  | FKDAT=billing_date,FKART=billing_type,FKSTO=cancelled_flag,KUNRG=payer_id,NETWR=revenue_amount,MWSBK=tax_amount,WAERK=currency,BUKRS=company_code
sat_customer | hk_customer |  | kna1 |  |  | NAME1=customer_name,LAND1=country,ORT01=city,STRAS=street,PSTLZ=postal_code,KTOKD=account_group,ERDAT=created_date
sat_equipment_general | hk_equipment |  | equi |  |  | SERGE=serial_number,HERST=manufacturer,TYPBZ=model_description,INBDT=startup_date,ERDAT=created_date,ERNAM=created_by,GEWRK=plant,EQART=equipment_category
sat_equipment_status | hk_equipment | status_from_date | eqbs |  |  | BEGDT=status_from_date,USTXT=status_code,STAT_DESC=status_description
sat_gr_header | hk_material_document |  | mkpf |  |  | BUDAT=posting_date,BLDAT=document_date,USNAM=posted_by,BKTXT=header_text,XBLNR=reference_document
sat_gr_item | hk_gr_material |  | mseg |  |  | ZEILE=document_item,BWART=movement_type,WERKS=plant,LGORT=storage_location,MENGE=quantity,MEINS=unit_of_measure,EBELN=purchase_order_number,EBELP=po_item_number,DMBTR=amount_local_currency,WAERS=currency,SERNP=serial_number_profile,LIFNR=vendor_id
sat_invoice_header | hk_invoice |  | rbkp |  |  | BLDAT=invoice_date,BUDAT=posting_date,LIFNR=vendor_id,WAERS=currency,RMWWR=invoice_total_amount,XBLNR=vendor_invoice_reference,EBELN=purchase_order_reference,USNAM=posted_by
sat_invoice_item | hk_invoice | invoice_line_item | rseg |  |  | BELNR=invoice_number,GJAHR=fiscal_year,BUZEI=invoice_line_item,EBELN=purchase_order_number,EBELP=po_item_number,MENGE=invoice_quantity,WRBTR=invoice_amount,WAERS=currency
sat_material_business | hk_material |  | zmm_material_business |  |  | LIFECYCLE_MONTHS=lifecycle_months,PRIMARY_VENDOR_ID=primary_vendor_id,NOTES=notes
sat_material_description | hk_material |  | makt | SPRAS = 'E' |  | SPRAS=language_key,MAKTX=material_description
sat_material_general | hk_material |  | mara |  |  | MTART=material_type,MATKL=material_group,MEINS=base_unit_of_measure,BRGEW=gross_weight_kg,GEWEI=weight_unit,MSTAE=cross_plant_status,SPART=division,PRDHA=product_hierarchy,ERDAT=created_date
sat_material_plant | hk_material_plant |  | marc |  |  | DISMM=mrp_type,DISPO=mrp_controller,EKGRP=purchasing_group,BESKZ=procurement_type,LGPRO=production_storage_location,PLIFZ=planned_delivery_time_days,SERNP=serial_number_profile
sat_movement_type | hk_movement_type |  | t156 |  |  | BWARK=movement_category,KZBEW=movement_indicator,SHKZG=debit_credit_indicator
sat_movement_type_text | hk_movement_type | spras | t156t |  |  | SPRAS=spras,SPRAS=language_code,BTEXT=short_text,LTEXT=long_text
sat_po_account | hk_po_item |  | ekkn |  |  | ZEKKN=account_assignment_number,SAKTO=gl_account,KOSTL=cost_center
sat_po_header | hk_purchase_order |  | ekko |  |  | BSTYP=document_category,BSART=document_type,EKORG=purchasing_organization,EKGRP=purchasing_group,BEDAT=po_date,WAERS=currency,RLWRT=total_po_value,BANFN=requisition_reference,ERNAM=created_by,AEDAT=last_changed_date,PROCSTAT=processing_status
sat_po_item | hk_po_material |  | ekpo |  |  | TXZ01=item_short_text,MENGE=ordered_quantity,MEINS=unit_of_measure,NETPR=unit_price,NETWR=net_value,WERKS=plant,LGORT=storage_location,MATKL=material_group,PSTYP=item_category,ELIKZ=delivery_completed_flag
sat_po_schedule | hk_po_item |  | eket |  |  | ETENR=schedule_line,EINDT=scheduled_delivery_date,MENGE=scheduled_quantity,WEMNG=goods_received_quantity
sat_pr_detail | hk_purchase_requisition |  | eban |  |  | MATNR=material_number,WERKS=plant,LGORT=storage_location,MENGE=requested_quantity,MEINS=unit_of_measure,PREIS=estimated_price,BADAT=requisition_date,FRGDT=release_date,ERNAM=created_by,ESTKZ=source_indicator,STATU=status,EKGRP=purchasing_group,EKORG=purchasing_organization
sat_sales_order | hk_sales_order |  | vbak |  |  | AUDAT=order_date,AUART=order_type,VKORG=sales_org,VTWEG=distribution_channel,SPART=division,KUNNR=customer_id,NETWR=order_value,WAERK=currency
sat_sales_order_item | hk_so_equipment |  | vbap |  |  | MATNR=service_plan_id,ARKTX=service_plan_name,MATKL=service_plan_group,KWMENG=quantity,VRKME=unit,NETWR=item_value,SERNR=device_serial,WERKS=plant
sat_service_plan | hk_service_plan |  | vbap |  | distinct | ARKTX=service_plan_name,MATKL=service_plan_group
sat_stock_level | hk_stock_location |  | mard |  |  | LGORT=storage_location,LABST=unrestricted_stock,INSME=quality_inspection_stock,SPEME=blocked_stock
sat_vendor_business | hk_vendor |  | zmm_vendor_business |  |  | EQUIPMENT_TYPES=equipment_types,CONTRACT_STATUS=contract_status,QUALITY_RATING=quality_rating,NOTES=notes
sat_vendor_commercial | hk_vendor |  | lfb1 |  |  | ZTERM=payment_terms,AKONT=reconciliation_account,ZWELS=payment_method,FDGRV=cash_management_group
sat_vendor_general | hk_vendor |  | lfa1 |  |  | NAME1=vendor_name,LAND1=country_code,ORT01=city,STRAS=street_address,TELF1=phone_number,ADRNR=address_number,ERDAT=created_date,ERNAM=created_by
sat_zmm_approval | hk_zmm_approval |  | zmm_approval_log |  |  | APPR_STATUS=approval_status,APPR_DATE=approval_date,APPR_USER=approval_user,REASON_CODE=reason_code,TOL_AMT=tolerance_amount,SGTXT=approval_text,EBELN=purchase_order_number,EBELP=po_item_number,BELNR=invoice_number,GJAHR=fiscal_year
"""


def _rows(text: str) -> list[list[str]]:
    return [[c.strip() for c in line.split("|")] for line in text.strip().splitlines()]


def _pairs(text: str, sep: str) -> dict[str, str]:
    return dict(x.strip().split("=", 1) for x in text.split(sep) if x.strip())


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


STAGING = {n: StagingSpec(src or n.upper(), {f"hk_{k}": _names(v) for k, v in _pairs(keys, ";").items()}, _names(dates), _pairs(casts, ";"), _names(change)) for n, src, keys, dates, casts, change in _rows(STAGING_TEXT)}
HUBS = {n: (table, HubSpec(key, _pairs(business, ","))) for n, key, business, table in _rows(HUBS_TEXT)}
LINKS = {n: (tables, LinkSpec(key, _names(recipe), _names(parents), where or None)) for n, key, recipe, parents, tables, where in _rows(LINKS_TEXT)}
SATS = {n: (table, SatSpec(key, _pairs(payload, ","), _names(child), where or None, bool(distinct))) for n, key, child, table, where, distinct, payload in _rows(SATS_TEXT)}


def build_staging(raw: Mapping[str, DataFrame], load_ts: str) -> dict[str, DataFrame]:
    """Every raw table that has a spec, staged."""
    return {n: stage(df, STAGING[n], load_ts) for n, df in raw.items() if n in STAGING}


def build_hubs(staged: Mapping[str, DataFrame], existing: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """New rows of every hub whose table is staged."""
    return {n: load_hub(staged[table], (existing or {}).get(n), spec) for n, (table, spec) in HUBS.items() if table in staged}


def _keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the hash keys that their table doesn't stage, by the recipe of the link or hub that they name."""
    recipes = {spec.key: STAGING[table].keys[spec.key] for table, spec in HUBS.values() if spec.key in STAGING[table].keys}
    recipes |= {spec.key: [c.split(".")[-1] for c in spec.recipe] for _, spec in LINKS.values() if spec.recipe}
    return rows.withColumns({k: hash_key(*recipes[k]) for k in keys if k not in rows.columns})


def build_links(staged: Mapping[str, DataFrame], existing: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """New rows of every link of one table; :func:`build_joined_links` has the others."""
    return {n: load_link(_keyed(staged[table], *spec.parents), (existing or {}).get(n), spec) for n, (table, spec) in LINKS.items() if "ON" not in table and table in staged}


def build_joined_links(staged: Mapping[str, DataFrame], existing: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """New rows of the links that meet by a join of two staged tables, where both are there.

    Columns that both sides have come from the table whose hash keys the link needs first.
    """
    joins = {
        "link_billing_accounting": ("vbrk", "v", "bkpf", "b", lambda v, b: b["AWKEY"] == F.concat(v["VBELN"], F.year(v["FKDAT"]).cast("string"))),
        "link_equipment_gr": ("seri", "s", "mkpf", "m", lambda s, m: m["MBLNR"] == s["MBLNR"]),
        "link_gr_accounting": ("mkpf", "m", "bkpf", "b", lambda m, b: b["AWKEY"] == F.concat(m["MBLNR"], m["MJAHR"])),
        "link_invoice_accounting": ("rbkp", "r", "bkpf", "b", lambda r, b: b["AWKEY"] == F.concat(r["BELNR"], r["GJAHR"])),
        "link_sales_order_equipment": ("vbap", "p", "equi", "e", lambda p, e: p["SERNR"] == e["SERGE"]),
    }
    out = {}
    for name, (x, x_as, y, y_as, on) in joins.items():
        if x not in staged or y not in staged:
            continue
        spec = LINKS[name][1]
        a, b = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)) for p, df in ((x_as, staged[x]), (y_as, staged[y])))
        look = lambda p, df: {c.removeprefix(f"{p}_"): df[c] for c in df.columns}
        rows = a.join(b, on(look(x_as, a), look(y_as, b)))
        flat = lambda c, rows=rows, x_as=x_as, y_as=y_as: F.col(c.replace(".", "_", 1)) if "." in c else F.col(f"{x_as}_{c}" if f"{x_as}_{c}" in rows.columns else f"{y_as}_{c}")
        if spec.where:
            rows = rows.filter(spec.where.replace(f"{x_as}.", f"{x_as}_").replace(f"{y_as}.", f"{y_as}_"))
        recipe = [f"_r{i}" for i in range(len(spec.recipe))]
        rows = rows.select(*(flat(c).alias(r) for c, r in zip(spec.recipe, recipe, strict=True)), *(flat(p).alias(p) for p in spec.parents), flat("load_date").alias("load_date"), flat("record_source").alias("record_source"))
        out[name] = load_link(rows, (existing or {}).get(name), LinkSpec(spec.key, recipe, spec.parents))
    return out


def build_sats(staged: Mapping[str, DataFrame], existing: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """New rows of every satellite whose table is staged."""
    return {n: load_sat(_keyed(staged[table], spec.key), (existing or {}).get(n), spec) for n, (table, spec) in SATS.items() if table in staged}
