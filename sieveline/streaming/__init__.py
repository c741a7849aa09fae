"""The stateless projections on Structured Streaming inputs."""
