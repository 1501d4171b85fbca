"""Schemas of the engine's tables and files."""

TARGETS = "id int, url string, ort string, typ string, ags string, plz string, landkreis string, bundesland string, last_scanned timestamp_ntz, content_hash string, subpage_hashes map<string,string>, url_redirect string, crawl_error_code string, crawl_error_count int"
FINDINGS = "id int, ags string, start_time timestamp_ntz, end_time timestamp_ntz, status string, gefundene_links int, massnahme string, adresse string, gefunden_am date, kategorie string, massnahme_start date, massnahme_ende date, massnahme_url string, content_hash string, lat double, lng double, geo_level string, source string"
RAW_LOG = "run_id string, url string, content_hash string, is_pdf boolean, http_status int, relevance_score float, relevance_label string, top_category string, confidence float, llm_relevant boolean, llm_confidence float, llm_reason string, fetch_time_ms float, text_snippet string, blocks_json string, crawled_at timestamp_ntz"
SEED_CONFIG = "random_seed int, csv_path string, filter_bundesland string, min_einwohner int, max_domains int, default_max_pages int, manual_overrides array<struct<name:string,url:string,ags:string,bundesland:string,einwohner:int,max_pages:int>>"
SCENARIO = "label string, seed_url string, max_pages int, reference_corpus_size int, goldstandard_path string, notes string"
GOLD = "domain string, annotator string, date string, entries array<struct<url:string,relevant:boolean,kategorie:string,notiz:string,quelle:string,aggregierte_urls:array<string>>>"
MEASURE = "kategorie string, massnahme string, adresse string, massnahme_start string, massnahme_ende string, quelle_url string, konfidenz double"
MODEL_RESULT = f"ort string, url string, modell string, timestamp string, funde int, kosten_usd double, latenz_s double, massnahmen array<struct<{', '.join(f.replace(' ', ':') for f in MEASURE.split(', '))}>>"
PAIRS = "instruction string, input string, output string, metadata map<string,string>"
EVENT = "ts timestamp, level string, event string, message string"
