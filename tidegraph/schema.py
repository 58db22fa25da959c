"""Schemas of edges, nodes, seeds and samples, and the configuration of a relation."""

from __future__ import annotations

from dataclasses import dataclass, field

EDGE_SCHEMA = "src long, dst long, weight double, ts long, seq long, int_attrs array<long>, float_attrs array<float>"
NODE_SCHEMA = "id long, degree long, edge_num long, expire_ts long, int_attrs array<long>, float_attrs array<float>"
SEED_SCHEMA = "seed_pos long, id long"

#: Ids of 0 stand for "no node" everywhere.
NO_NODE = 0
TEN_YEARS = 10 * 365 * 86400

STRATEGIES = ("random", "weight", "most_recent", "least_recent", "topn_weight")
PADDINGS = ("zero", "self", "neigh_loop", "no_padding")
INSERT_ACTIONS = ("add", "replace", "max", "avg")
EVICTIONS = ("lru", "random", "weight", "cancel")
CONTAINERS = ("cdf", "cpt", "cpt_precise_weight_indexed")


def choose(name: str, allowed: tuple[str, ...], what: str) -> str:
    """The name, if it is one of the allowed ones."""
    if name not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}; got {name!r}")
    return name


@dataclass(frozen=True)
class RelationConfig:
    """Settings of a relation; edge lists hold edge_max_num edges a source at most."""

    name: str
    edge_max_num: int = 1000
    expire_interval: int = 0
    elst: str = "cpt"
    int_attr_len: int = 0
    float_attr_len: int = 0
    edge_int_attr_len: int = 0
    edge_float_attr_len: int = 0
    eviction: str = "lru"
    edge_expire_interval_s: int = 0
    weight_decay_ratio: float = 1.0
    degree_decay_ratio: float = 1.0
    delete_threshold_weight: float = 1e-6
    decay_interval_s: int = 86400
    max_occupancy_rate: float = 0.9
    reduce_occupancy_rate: float = 0.05
    reduce_by: str = "degree"
    seed: int = field(default=1)

    def __post_init__(self):
        choose(self.elst, CONTAINERS, "elst")
        choose(self.eviction, EVICTIONS, "eviction")
        choose(self.reduce_by, ("degree", "age"), "reduce_by")
        if self.edge_max_num < 1 or (not self.multigraph and self.edge_max_num >= 65535):
            raise ValueError("edge_max_num must be positive and, unless elst is 'cdf', below 65535")
        for ratio in (self.weight_decay_ratio, self.degree_decay_ratio):
            if not 0 < ratio <= 1:
                raise ValueError("decay ratios lie in (0, 1]")
        if self.multigraph and self.eviction not in ("lru", "cancel"):
            raise ValueError("a cdf relation evicts by 'lru' or 'cancel'")

    @property
    def multigraph(self) -> bool:
        """cdf lists keep every edge of a pair; the others keep one."""
        return self.elst == "cdf"

    @property
    def precise(self) -> bool:
        return self.elst == "cpt_precise_weight_indexed"

    @property
    def life(self) -> int:
        """Seconds a node lives; 0 stands for ten years."""
        return self.expire_interval or TEN_YEARS


#: Names that a configuration document gives to settings of a relation.
SETTINGS = {
    "relation_name": "name", "edge_max_num": "edge_max_num", "expire_interval": "expire_interval", "elst": "elst",
    "edge_expire_interval_s": "edge_expire_interval_s", "weight_decay_ratio": "weight_decay_ratio", "degree_decay_ratio": "degree_decay_ratio",
    "delete_threshold_weight": "delete_threshold_weight", "decay_interval_s": "decay_interval_s",
    "max_occupancy_rate": "max_occupancy_rate", "reduce_occupancy_rate": "reduce_occupancy_rate",
}


def relation_configs(document: dict, host: str) -> list[tuple[RelationConfig, list[dict]]]:
    """Each relation of a host with its loaders."""
    found = []
    for db in resolve_config(document, host)["dbs"]:
        given = {SETTINGS[k]: v for k, v in db.items() if k in SETTINGS}
        for prefix in ("", "edge_"):
            sizes = db.get(f"{prefix}attr_op_config", {})
            given |= {f"{prefix}{kind}_attr_len": sizes.get(f"{name}_max_size", 0) for kind, name in (("int", "int"), ("float", "float"))}
        if "oversize_replace_strategy" in db:
            given["eviction"] = EVICTIONS[db["oversize_replace_strategy"]]
        if "reduce_occupancy_strategy" in db:
            given["reduce_by"] = ("degree", "age")[db["reduce_occupancy_strategy"]]
        found.append((RelationConfig(**given), db["init"]))
    return found


def resolve_config(document: dict, host: str) -> dict:
    """The service settings of a host: host entry or 'default', with its relations and loaders looked up by name."""
    hosts, services = document["host_service_config"], document["service_config"]
    service = dict(services[hosts.get(host, hosts.get("default"))])
    known = {d["relation_name"]: d for d in document.get("db_list", [])}
    loaders = {d["name"]: d for d in document.get("init_list", [])}
    service["dbs"] = [dict(known[d]) if isinstance(d, str) else dict(d) for d in service.get("dbs", [])]
    for db in service["dbs"]:
        init = db.get("init", service.get("default_init", []))
        db["init"] = [loaders[i] for i in ([init] if isinstance(init, str) else init) if isinstance(i, str)] + [i for i in ([] if isinstance(init, str) else init) if not isinstance(i, str)]
    return service
