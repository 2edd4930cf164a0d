"""Gene tables of fixed content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The pathway label of a gene; any other gene is "other".
PATHWAY_LABELS = {
    "oxidative_stress": "NFE2L2 NRF2 SOD1 SOD2 CAT GPX1 GPX4 HMOX1 NQO1 TXNRD1 PRDX1 GSR",
    "apoptosis": "TP53 BAX BCL2 CASP3 CASP8 CASP9 APAF1 BID BAK1 MCL1 PUMA NOXA CYCS DIABLO",
    "dna_damage": "ATM ATR BRCA1 BRCA2 RAD51 XRCC1 PARP1 H2AFX MDM2 CHEK1 CHEK2",
    "cell_cycle": "CDKN1A CDK2 CDK4 CCND1 CCNE1 RB1 E2F1",
    "immune": "CD274 PDCD1LG2 IFNG TNF IL6 IL1B CXCL8 STAT1 STAT3 JAK2",
    "m6a_machinery": "METTL3 METTL14 WTAP FTO ALKBH5 YTHDF1 YTHDF2 YTHDF3 YTHDC1 YTHDC2",
    "melanoma_driver": "BRAF NRAS KIT MITF PTEN CDKN2A",
}
#: The curated gene sets of the enrichment.
CURATED_SETS = {
    "Oxidative_Stress_Response": "NFE2L2 NRF2 SOD1 SOD2 CAT GPX1 GPX4 HMOX1 NQO1 TXNRD1 PRDX1 PRDX2 PRDX3 GSR GCLC GCLM TXN TXNRD2 SRXN1 KEAP1",
    "Apoptosis": "TP53 BAX BCL2 BCL2L1 CASP3 CASP7 CASP8 CASP9 APAF1 BID BAK1 MCL1 BBC3 PMAIP1 CYCS DIABLO XIAP BIRC5 FAS FASLG TRAIL",
    "DNA_Damage_Response": "ATM ATR BRCA1 BRCA2 RAD51 XRCC1 XRCC4 PARP1 H2AFX MDM2 CHEK1 CHEK2 TP53BP1 RPA1 RAD50 MRE11 NBN GADD45A GADD45B",
    "Cell_Cycle": "CDKN1A CDKN2A CDKN1B CDK2 CDK4 CDK6 CCND1 CCNE1 CCNA2 CCNB1 RB1 E2F1 E2F2 MYC CDC25A CDC25C PLK1 AURKA AURKB",
    "Immune_Regulation": "CD274 PDCD1LG2 IFNG IFNB1 TNF IL6 IL1B CXCL8 STAT1 STAT3 JAK1 JAK2 IRF1 IRF3 NFKB1 RELA CXCL10 CCL2 IL10 TGFB1",
    "m6A_RNA_Modification": "METTL3 METTL14 WTAP RBM15 RBM15B VIRMA ZC3H13 FTO ALKBH5 YTHDF1 YTHDF2 YTHDF3 YTHDC1 YTHDC2 IGF2BP1 IGF2BP2 IGF2BP3 HNRNPA2B1 HNRNPC",
    "Melanoma_Signaling": "BRAF NRAS KIT MITF PTEN CDKN2A AKT1 MAPK1 MAPK3 RAF1 MEK1 ERK2 SOX10 MC1R GNAQ GNA11 NF1 RAS",
    "Hypoxia_Response": "HIF1A EPAS1 ARNT VHL VEGFA VEGFB EPO LDHA PDK1 SLC2A1 SLC2A3 CA9 ADM BNIP3 BNIP3L EGLN1 EGLN2 EGLN3",
}


def pairs(table: dict[str, str]) -> list[tuple[str, str]]:
    return [(name, gene) for name, genes in table.items() for gene in genes.split()]


def pathway_labels(spark: SparkSession) -> DataFrame:
    """(gene, label), one row a gene."""
    return spark.createDataFrame([(g, n) for n, g in pairs(PATHWAY_LABELS)], "gene string, label string")


def curated_sets(spark: SparkSession) -> DataFrame:
    """(pathway, gene)."""
    return spark.createDataFrame(pairs(CURATED_SETS), "pathway string, gene string")
