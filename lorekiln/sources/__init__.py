"""Readers of chat logs. Each returns sessions: session_id, source, project, git_branch, started_at,
ended_at, working_directory, summary, files array<string>, exchanges array<struct<n, role, content, timestamp, tools>>."""
