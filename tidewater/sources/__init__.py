"""Readers of pings, deployments, recordings, embeddings, cluster state and annotations."""
