"""Writers of selections, cluster state, metadata, clips and failures."""
