"""Declared tables: column name in the library, header in the file, type.

Files are read as text by header and cast here, so that nothing is inferred and a
missing column is an error at the edge.
"""

from __future__ import annotations

Spec = dict[str, tuple[str, str]]

BURDEN: Spec = {
    "measure": ("measure", "string"), "location": ("location", "string"), "sex": ("sex", "string"), "age": ("age", "string"),
    "cause": ("cause", "string"), "metric": ("metric", "string"), "year": ("year", "int"), "val": ("val", "double"),
}
POPULATION: Spec = {
    "location": ("location_name", "string"), "sex": ("sex_name", "string"), "age": ("age_group_name", "string"),
    "year": ("year_id", "int"), "nx": ("val", "double"),
}
SURVEY: Spec = {
    "age": ("Age", "string"), "sex": ("Sex", "string"), "current": ("Current smokers", "double"), "ex": ("Ex-smokers", "double"),
    "year": ("Year", "int"),
}
STATUS_EFFECTS: Spec = {
    "code": ("Code", "decimal(3,1)"), "name": ("Intervention", "string"), "target": ("Target", "string"), "age_text": ("Age", "string"),
    "rrr": ("RRR", "double"),
}
RISKS: Spec = {"cause": ("Cause", "string"), "rr": ("RR", "double"), "category": ("Category", "string"), "sex": ("Sex", "string")}
CLINICAL_EFFECTS: Spec = {
    "name": ("Intervention", "string"), "cause": ("cause", "string"), "target": ("target", "string"), "rr": ("RR", "double"),
}
NAMES: Spec = {"code": ("Code", "decimal(3,1)"), "name": ("Intervention", "string")}
COSTS: Spec = {"code": ("Code", "decimal(3,1)"), "total_cost": ("Total", "double")}
BIRTHS: Spec = {
    "location": ("location", "string"), "year": ("year", "int"), "births": ("Nx0", "double"), "sex": ("sex", "string"), "age": ("age", "int"),
}
RESULTS: Spec = {
    "year": ("year", "int"), "code": ("Code", "decimal(3,1)"), "dead": ("dead", "double"), "newcases": ("newcases", "double"),
}
CASCADE: Spec = {
    "year": ("year", "int"), "sex": ("sex", "string"), "htn": ("HTN", "double"), "aware": ("Aware", "double"),
    "treated": ("Treated", "double"), "control": ("Control", "double"), "dm": ("DM", "double"),
    "connection": ("connection.to.care", "double"), "quality": ("quality.of.care", "double"),
}
STATUS_PANEL: Spec = {
    "age": ("age", "int"), "year": ("year", "int"), "sex": ("Sex", "string"), "never": ("Never", "double"),
    "current": ("Current", "double"), "ex": ("Ex", "double"), "init": ("init", "double"), "cess": ("cess", "double"),
}
RATES: Spec = {
    "year": ("year", "int"), "location": ("location", "string"), "cause": ("cause", "string"), "sex": ("sex", "string"),
    "age": ("age", "int"), "all_mx": ("all.mx", "double"), "dis_mx": ("dis.mx", "double"), "bg_mx": ("bg.mx", "double"),
    "bg_mx_all": ("bg.mx.all", "double"), "prev_rate": ("prev.rate", "double"), "nx": ("Nx", "double"), "ir": ("IR", "double"),
    "cf": ("CF", "double"),
}
