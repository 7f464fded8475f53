"""The derived tables themselves, against their defining SQL."""

from wattline.catalog.registry import query

_DIMS = "region:s partenaire:s contrat:i activite:s annee:i mois:i"

query("table_contract_months", _DIMS + " consommation_kwh:d consommation_zconhc:d consommation_zconhl:d "
      "consommation_zconhp:d puissance_facturee:d puissance_appelee:d niveau_tension:s",
      "select * from cd", "cd", scale=2)(lambda t: t.cd)
query("table_regional_months", "annee:i mois:i activite:s grd:s classe:s region:s consommation_kwh:d nbr_clients:i",
      "select * from grd", "grd", scale=2)(lambda t: t.grd)
query("table_exogenous", "region:s annee:i pib_mdh:d gdp_primaire:d gdp_secondaire:d gdp_tertiaire:d",
      "select * from exogenous", "exogenous", scale=6)(lambda t: t.exogenous)
query("table_daily_weather", "region:s date_jour:t annee:i mois:i apparent_temperature_min:d "
      "apparent_temperature_mean:d apparent_temperature_max:d precipitation_sum:d et0_fao_evapotranspiration_sum:d",
      "select * from weather", "weather")(lambda t: t.weather)
query("table_contract_dates", "contrat:i date_emmenagement:s date_demenagement:s",
      "select * from contract_dates", "contract_dates")(lambda t: t.contract_dates)
query("table_ev_load", "region:s annee:i ev:d", "select * from ev", "ev")(lambda t: t.ev)
query("table_weather_differences", "region:s annee:i temp_min_diff:d precipitation_sum_diff:d et0_diff:d",
      "select * from weather_diff", "weather_diff")(lambda t: t.weather_diff)
