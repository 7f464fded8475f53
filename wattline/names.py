"""Column names and fixed labels of the monthly electricity tables."""

REGION = "region"
PARTENAIRE = "partenaire"
CONTRAT = "contrat"
ACTIVITE = "activite"
ANNEE = "annee"
MOIS = "mois"
GRD = "grd"
CLASSE = "classe"
CONSO = "consommation_kwh"
ZCONHC = "consommation_zconhc"
ZCONHL = "consommation_zconhl"
ZCONHP = "consommation_zconhp"
PF = "puissance_facturee"
PA = "puissance_appelee"
CLIENTS = "nbr_clients"
TENSION = "niveau_tension"
DATE_IN = "date_emmenagement"
DATE_OUT = "date_demenagement"

BANDS = (ZCONHC, ZCONHL, ZCONHP)
GDP = ("pib_mdh", "gdp_primaire", "gdp_secondaire", "gdp_tertiaire")
MONTHS = tuple(range(1, 13))

# Fixed values of the source tables.
SRM = "SRM"
CLASS_MT, CLASS_BT, CLASS_TOTAL = "MT", "BT", "Total"
TOTAL = "Total"
ALL_DISTRIBUTORS = "All distributers"
ADMINISTRATIF, ADMINISTRATIF_MT = "Administratif", "Administratif_mt"
DEFAULT_TENSION = "HT"
NEVER = 9999

# Fixed headers of the four result tables.
STF_SRM_HEADER = {"region": "Region", "activite": "Activity", "annee": "Year", "mois": "Month",
                  "consommation": "Consommation"}
STF_CD_HEADER = {"region": "Region", "partenaire": "Partenaire", "contrat": "Contrat",
                 "activite": "Activity", "annee": "Year", "mois": "Month",
                 "consommation": "Consommation_Total", "consommation_zconhc": "Consommation_ZCONHC",
                 "consommation_zconhl": "Consommation_ZCONHL", "consommation_zconhp": "Consommation_ZCONHP",
                 "puissance_facturee": "Puissance_Facturee", "niveau_tension": "Niveau_tension"}
LTF_SRM_HEADER = {"region": "Region", "annee": "Year", "consommation": "Consommation"}
LTF_CD_HEADER = {k: v for k, v in STF_CD_HEADER.items() if k != "mois"}

# Forecast variables: the measure each one reads and whether distributors report it.
VARIABLES = {
    "consommation_kwh": {"column": CONSO, "distributors": True},
    "nbr_clients": {"column": CLIENTS, "distributors": False},
}
