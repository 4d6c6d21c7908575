"""Column layouts of the input tables."""

OBSERVATIONS = ("checklist_id string, common_name string, observation_count string, state string, "
                "country string, country_code string, state_code string, approved boolean")

EVENTS = ("checklist_id string, group_id string, country string, country_code string, state string, "
          "state_code string, locality_id string, locality string, locality_type string, "
          "latitude double, longitude double, observation_date date, "
          "time_observations_started string, protocol_code string, protocol_type string, "
          "project_code string, duration_minutes double, effort_distance_km double, "
          "effort_area_ha double, number_observers int, all_species_reported boolean")

WORKBOOK = ("survey_code string, site_code string, survey_site string, species string, "
            "ob_count string, day int, month int, year int, time_start timestamp, "
            "time_end timestamp, province string, surveyor string, latitude double, longitude double")

SITES = "locality_id string, locality string, state_code string, latitude double, longitude double"

SPECIES = ("species string, large_flocks int, small_flocks int, two_seasons boolean, "
           "regions_w_alt_season string")

GENERATIONS = "scientific_name string, common_name string, gen_length double"

VERTICES = "poly_id string, seq int, x double, y double"
