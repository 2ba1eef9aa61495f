"""Spark schemas of the tables that enter and leave the engine (DDL strings)."""

POINTS = "track_id string, track_idx int, seq bigint, lat double, lon double, ele double, time string"
ELEMENTS = (
    "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
)
SNIPPETS = "poi_id string, pos int, title string, url string, content string, engine string"
STRUCTURED_DATA = (
    "struct<description:string,telephone:string,priceRange:string,openingHours:array<string>,"
    "rating:double,reviewCount:double>"
)
SEARCH_RESPONSE = (
    "results array<struct<title:string,url:string,content:string,engine:string,score:double>>, query string, "
    "number_of_results bigint, unresponsive_engines array<array<string>>"
)
GEOCODE_RESPONSE = (
    "address struct<city:string,town:string,village:string,hamlet:string,municipality:string,county:string,"
    "state:string,country:string,country_code:string>, display_name string"
)
HOURS = "array<struct<day:string,open:string,close:string>>"
CACHE = (
    "osm_type string, osm_id bigint, category string, lat double, lon double, name string, enrichment string, "
    "enriched_at timestamp, updated_at timestamp"
)
JOBS = (
    "job_id string, status string, source string, url string, poi_name string, error string, attempt int, "
    "created_at timestamp, updated_at timestamp, started_at timestamp, next_retry_at timestamp, last_error string"
)
FAILURES = (
    "source string, url string, poiName string, attempts int, lastError string, failedAt timestamp"
)
GPX = (
    "metadata struct<name:string>, "
    "trk array<struct<name:string,trkseg:array<struct<trkpt:array<struct<_lat:string,_lon:string,ele:string,time:string>>>>>>, "
    "rte array<struct<name:string,rtept:array<struct<_lat:string,_lon:string,ele:string,time:string>>>>, "
    "_corrupt_record string"
)
