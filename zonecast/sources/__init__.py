from zonecast.sources.adapter import (observations, obs_dup, obs_score, obs_train,
                                     oracle_obs_cte, read_table)
from zonecast.sources.readers import (literal_observations, read_observations,
                                          read_observations_csv, read_optional,
                                          read_submission)

__all__ = ["observations", "obs_train", "obs_score", "obs_dup", "oracle_obs_cte",
           "read_table", "read_observations", "read_observations_csv", "read_optional",
           "read_submission", "literal_observations"]
