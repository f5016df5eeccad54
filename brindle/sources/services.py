"""The service catalogue: values that are secrets of a service named by the identifier or the path beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import names, values

# Keyword, display name, environment variable, patterns of secret and of public values.
SERVICES = (
    ("adafruit", "Adafruit", "ADAFRUIT_IO_KEY", (r"^[a-z0-9_\-]{32}$",), ()),
    ("adobe", "Adobe", "ADOBE_API_KEY", (r"^[a-f0-9]{32}$",), ()),
    ("airtable", "Airtable", "AIRTABLE_API_KEY", (r"^pat[a-zA-Z0-9]{14}\.[a-f0-9]{64}$", r"^[a-z0-9]{17}$"), ()),
    ("aiven", "Aiven", "AIVEN_API_TOKEN", (r"^[a-zA-Z0-9/+=]{372}$",), ()),
    ("alchemy", "Alchemy", "ALCHEMY_API_KEY", (r"^[a-zA-Z0-9_\-]{32}$",), ()),
    ("algolia", "Algolia", "ALGOLIA_API_KEY", (r"^[a-z0-9]{32}$",), ()),
    ("alibaba", "Alibaba Cloud", "ALIBABA_CLOUD_ACCESS_KEY_SECRET", (r"^[a-zA-Z0-9]{30,}$",), ()),
    ("amplitude", "Amplitude", "AMPLITUDE_API_KEY", (r"^[a-f0-9]{32}$",), ()),
    ("assemblyai", "AssemblyAI", "ASSEMBLYAI_API_KEY", (r"^[0-9a-z]{32}$",), ()),
    ("asana", "Asana", "ASANA_ACCESS_TOKEN", (r"^[0-9]+/[0-9]{16,}(?:/[0-9]{16,})?:[A-Za-z0-9]{32,}$", r"^[0-9]{16}$", r"^[a-z0-9]{32}$"), ()),
    ("auth0", "Auth0", "AUTH0_CLIENT_SECRET", (r"^[a-zA-Z0-9_\-]{32,}$",), ()),
    ("azure", "Azure", "AZURE_CLIENT_SECRET", (r"^[a-zA-Z0-9+/=_\-]{32,}$", r"^[a-zA-Z0-9_~.]{3}\dQ~[a-zA-Z0-9_~.\-]{31,34}$"), ()),
    ("azuredevops", "Azure DevOps", "AZURE_DEVOPS_PAT", (r"^[a-z0-9]{52}$",), ()),
    ("backstage", "Backstage", "BACKSTAGE_TOKEN", (r"^[a-zA-Z0-9_\-]{32,}$",), ()),
    ("beamer", "Beamer", "BEAMER_API_KEY", (r"^b_[a-zA-Z0-9=_+/\-]{44}$",), ()),
    ("braintree", "Braintree", "BRAINTREE_TOKENIZATION_KEY", (r"^(?:production|sandbox)_[0-9a-z]{8}_[0-9a-z]{16,}$",), ()),
    ("bugsnag", "Bugsnag", "BUGSNAG_API_KEY", (r"^[0-9a-z]{8}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{12}$",), ()),
    ("buildkite", "Buildkite", "BUILDKITE_AGENT_TOKEN", (r"^[a-f0-9]{40}$",), ()),
    ("bitbucket", "Bitbucket", "BITBUCKET_APP_PASSWORD", (r"^[a-z0-9]{32}$", r"^[a-z0-9=_\-]{64}$"), ()),
    ("bittrex", "Bittrex", "BITTREX_API_SECRET", (r"^[a-z0-9]{32}$",), ()),
    ("clickup", "ClickUp", "CLICKUP_API_TOKEN", (r"^pk_[0-9]{7,9}_[0-9A-Z]{32}$",), ()),
    ("cloudflare", "Cloudflare", "CLOUDFLARE_API_TOKEN", (r"^v1\.0-[A-Za-z0-9\-]{171}$", r"^[a-zA-Z0-9_\-]{40}$", r"^[a-zA-Z0-9_\-]{37}$"), ()),
    ("circleci", "CircleCI", "CIRCLECI_TOKEN", (r"^[a-fA-F0-9]{40}$",), ()),
    ("codacy", "Codacy", "CODACY_API_TOKEN", (r"^[0-9A-Za-z]{20}$",), ()),
    ("codeclimate", "Code Climate", "CODECLIMATE_API_TOKEN", (r"^[a-f0-9]{40}$",), ()),
    ("codecov", "Codecov", "CODECOV_TOKEN", (r"^[a-z0-9]{32}$",), ()),
    ("cohere", "Cohere", "COHERE_API_KEY", (r"^[a-zA-Z0-9]{40}$",), ()),
    ("coinbase", "Coinbase", "COINBASE_API_KEY", (r"^[a-z0-9_\-]{64}$",), ()),
    ("confluent", "Confluent", "CONFLUENT_API_SECRET", (r"^[a-zA-Z0-9]{16}$", r"^[a-zA-Z0-9+/]{64}$"), ()),
    ("contentful", "Contentful", "CONTENTFUL_ACCESS_TOKEN", (r"^[a-z0-9=_\-]{43}$",), ()),
    ("coveralls", "Coveralls", "COVERALLS_REPO_TOKEN", (r"^[a-zA-Z0-9\-]{37}$",), ()),
    ("cosmosdb", "Azure CosmosDB", "AZURE_COSMOS_KEY", (r"^[a-zA-Z0-9+/]{80,}={0,2}$",), ()),
    ("crowdin", "Crowdin", "CROWDIN_API_TOKEN", (r"^[0-9A-Za-z]{80}$",), ()),
    ("datadog", "Datadog", "DATADOG_API_KEY", (r"^[a-zA-Z0-9\-]{40}$", r"^[a-zA-Z0-9\-]{32}$"), ()),
    ("deepgram", "Deepgram", "DEEPGRAM_API_KEY", (r"^[0-9a-z]{40}$",), ()),
    ("deepseek", "DeepSeek", "DEEPSEEK_API_KEY", (r"^sk-[a-z0-9]{32}$",), ()),
    ("discord", "Discord", "DISCORD_BOT_TOKEN", (r"^[A-Za-z0-9_\-]{24}\.[A-Za-z0-9_\-]{6}\.[A-Za-z0-9_\-]{27}$", r"^[a-f0-9]{64}$", r"^[0-9]{18}$", r"^[a-z0-9=_\-]{32}$"), ()),
    ("droneci", "Drone CI", "DRONE_TOKEN", (r"^[a-zA-Z0-9]{32}$",), ()),
    ("elevenlabs", "ElevenLabs", "ELEVENLABS_API_KEY", (r"^[a-f0-9]{32}$", r"^sk_[a-f0-9]{48}$"), ()),
    ("eth", "Ethereum", "ETH_PRIVATE_KEY", (r"^(?:0x)?[a-fA-F0-9]{64}$",), ()),
    ("ethereum", "Ethereum", "ETHEREUM_PRIVATE_KEY", (r"^(?:0x)?[a-fA-F0-9]{64}$",), ()),
    ("etherscan", "Etherscan", "ETHERSCAN_API_KEY", (r"^[A-Z0-9]{34}$",), ()),
    ("eventbrite", "Eventbrite", "EVENTBRITE_API_KEY", (r"^[0-9A-Z]{20}$",), ()),
    ("etsy", "Etsy", "ETSY_API_KEY", (r"^[a-z0-9]{24}$",), ()),
    ("facebook", "Facebook", "FACEBOOK_ACCESS_TOKEN", (r"^[a-f0-9]{32}$",), ()),
    ("fastly", "Fastly", "FASTLY_API_TOKEN", (r"^[a-zA-Z0-9=_\-]{32}$",), ()),
    ("fireworks", "Fireworks AI", "FIREWORKS_API_KEY", (r"^[a-zA-Z0-9]{32,}$",), ()),
    ("finicity", "Finicity", "FINICITY_APP_KEY", (r"^[a-f0-9]{32}$", r"^[a-z0-9]{20}$"), ()),
    ("finnhub", "Finnhub", "FINNHUB_API_KEY", (r"^[a-z0-9]{20}$",), ()),
    ("flickr", "Flickr", "FLICKR_API_KEY", (r"^[a-z0-9]{32}$",), ()),
    ("freshbooks", "FreshBooks", "FRESHBOOKS_ACCESS_TOKEN", (r"^[a-z0-9]{64}$",), ()),
    ("gitter", "Gitter", "GITTER_TOKEN", (r"^[a-z0-9_\-]{40}$",), ()),
    ("gocardless", "GoCardless", "GOCARDLESS_ACCESS_TOKEN", (r"^live_[a-zA-Z0-9\-_=]{40}$",), ()),
    ("infura", "Infura", "INFURA_PROJECT_ID", (r"^[a-f0-9]{32}$",), ()),
    ("jumpcloud", "JumpCloud", "JUMPCLOUD_API_KEY", (r"^[a-zA-Z0-9]{40}$",), ()),
    ("heroku", "Heroku", "HEROKU_API_KEY", (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",), ()),
    ("hubspot", "HubSpot", "HUBSPOT_ACCESS_TOKEN", (r"^[a-zA-Z0-9]{8}-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{12}$",), ()),
    ("intercom", "Intercom", "INTERCOM_ACCESS_TOKEN", (r"^[a-zA-Z0-9=_+/\-]{60}$",), ()),
    ("kraken", "Kraken", "KRAKEN_PRIVATE_KEY", (r"^[a-z0-9/=_+\-]{80,90}$",), ()),
    ("kucoin", "KuCoin", "KUCOIN_API_SECRET", (r"^[a-f0-9]{24}$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), ()),
    ("launchdarkly", "LaunchDarkly", "LAUNCHDARKLY_SDK_KEY", (r"^(?:api|sdk)-[a-z0-9]{8}-[a-z0-9]{4}-4[a-z0-9]{3}-[a-z0-9]{4}-[a-z0-9]{12}$", r"^[a-z0-9=_\-]{40}$"), ()),
    ("linkedin", "LinkedIn", "LINKEDIN_CLIENT_SECRET", (r"^[a-z0-9]{14}$", r"^[a-z0-9]{16}$"), ()),
    ("lob", "Lob", "LOB_API_KEY", (r"^(?:live|test)_[a-f0-9]{35}$",), (r"^(?:test|live)_pub_[a-f0-9]{31}$",)),
    ("looker", "Looker", "LOOKER_API_SECRET", (r"^[a-z0-9]{20}$", r"^[a-z0-9]{24}$"), ()),
    ("mailchimp", "Mailchimp", "MAILCHIMP_API_KEY", (r"^[a-f0-9]{32}-us\d\d$",), ()),
    ("mandrill", "Mandrill", "MANDRILL_API_KEY", (r"^[A-Za-z0-9_\-]{22}$",), ()),
    ("mailgun", "Mailgun", "MAILGUN_API_KEY", (r"^key-[a-f0-9]{32}$", r"^pubkey-[a-f0-9]{32}$", r"^[a-f0-9]{32}-[a-f0-9]{8}-[a-f0-9]{8}$", r"^[a-zA-Z0-9\-]{72}$"), ()),
    ("mapbox", "Mapbox", "MAPBOX_ACCESS_TOKEN", (r"^sk\.[a-zA-Z0-9.\-]{80,240}$", r"^pk\.[a-z0-9]{60}\.[a-z0-9]{22}$"), ()),
    ("mistral", "Mistral AI", "MISTRAL_API_KEY", (r"^[a-zA-Z0-9]{32}$",), ()),
    ("mixpanel", "Mixpanel", "MIXPANEL_TOKEN", (r"^[a-zA-Z0-9\-]{32}$",), ()),
    ("mattermost", "Mattermost", "MATTERMOST_TOKEN", (r"^[a-z0-9]{26}$",), ()),
    ("meraki", "Cisco Meraki", "MERAKI_API_KEY", (r"^[0-9a-f]{40}$",), ()),
    ("messagebird", "MessageBird", "MESSAGEBIRD_API_KEY", (r"^[a-z0-9]{25}$",), ()),
    ("netlify", "Netlify", "NETLIFY_AUTH_TOKEN", (r"^[a-zA-Z0-9=_\-]{40,46}$",), ()),
    ("notion", "Notion", "NOTION_API_KEY", (r"^secret_[A-Za-z0-9]{43}$",), ()),
    ("nytimes", "NY Times", "NYTIMES_API_KEY", (r"^[a-z0-9=_\-]{32}$",), ()),
    ("moralis", "Moralis", "MORALIS_API_KEY", (r"^[a-zA-Z0-9]{32,}$",), ()),
    ("okta", "Okta", "OKTA_API_TOKEN", (r"^00[a-zA-Z0-9=_\-]{40}$",), ()),
    ("optimizely", "Optimizely", "OPTIMIZELY_API_TOKEN", (r"^[0-9A-Za-z\-:]{54}$",), ()),
    ("opsgenie", "Opsgenie", "OPSGENIE_API_KEY", (r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",), ()),
    ("pagerduty", "PagerDuty", "PAGERDUTY_API_KEY", (r"^[a-zA-Z0-9+/=_\-]{20}$",), ()),
    ("pipedream", "Pipedream", "PIPEDREAM_API_KEY", (r"^[a-z0-9]{32}$",), ()),
    ("plaid", "Plaid", "PLAID_SECRET", (r"^access-(?:sandbox|development|production)-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[a-z0-9]{24}$", r"^[a-z0-9]{30}$"), ()),
    ("pinecone", "Pinecone", "PINECONE_API_KEY", (r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",), ()),
    ("postmark", "Postmark", "POSTMARK_SERVER_TOKEN", (r"^[0-9a-z]{8}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{12}$",), ()),
    ("privateai", "Private AI", "PRIVATEAI_API_KEY", (r"^[a-z0-9]{32}$",), ()),
    ("qdrant", "Qdrant", "QDRANT_API_KEY", (r"^[a-zA-Z0-9_\-]{32,}$",), ()),
    ("railway", "Railway", "RAILWAY_TOKEN", (r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",), ()),
    ("rapidapi", "RapidAPI", "RAPIDAPI_KEY", (r"^[a-z0-9_\-]{50}$",), ()),
    ("render", "Render", "RENDER_API_KEY", (r"^rnd_[a-zA-Z0-9]{32,}$",), ()),
    ("shodan", "Shodan", "SHODAN_API_KEY", (r"^[a-zA-Z0-9]{32}$",), ()),
    ("segment", "Segment", "SEGMENT_WRITE_KEY", (r"^[A-Za-z0-9_\-]{43}\.[A-Za-z0-9_\-]{43}$", r"^[a-zA-Z0-9]{32}$"), ()),
    ("sendbird", "Sendbird", "SENDBIRD_APP_TOKEN", (r"^[a-f0-9]{40}$",), ()),
    ("semaphore", "Semaphore CI", "SEMAPHORE_API_TOKEN", (r"^[a-f0-9]{32,}$",), ()),
    ("sentry", "Sentry", "SENTRY_DSN", (r"^[a-f0-9]{64}$",), ()),
    ("sparkpost", "SparkPost", "SPARKPOST_API_KEY", (r"^[a-zA-Z0-9]{40}$",), ()),
    ("snyk", "Snyk", "SNYK_TOKEN", (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",), ()),
    ("sonar", "SonarQube", "SONAR_TOKEN", (r"^[a-z0-9=_\-]{40}$",), ()),
    ("square", "Square", "SQUARE_ACCESS_TOKEN", (r"^[\w\-+=]{22,60}$",), ()),
    ("statuspage", "Statuspage", "STATUSPAGE_API_KEY", (r"^[0-9a-z\-]{36}$",), ()),
    ("storyblok", "Storyblok", "STORYBLOK_API_TOKEN", (r"^[0-9A-Za-z]{22}tt$",), ()),
    ("squarespace", "Squarespace", "SQUARESPACE_API_KEY", (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",), ()),
    ("sumo", "Sumo Logic", "SUMO_ACCESS_KEY", (r"^su[a-zA-Z0-9]{12}$", r"^[a-z0-9]{64}$"), ()),
    ("supabase", "Supabase", "SUPABASE_KEY", (r"^[a-zA-Z0-9_\-]{32,}$",), ()),
    ("todoist", "Todoist", "TODOIST_API_TOKEN", (r"^[0-9a-z]{40}$",), ()),
    ("together", "Together AI", "TOGETHER_API_KEY", (r"^[a-f0-9]{64}$",), ()),
    ("telegram", "Telegram", "TELEGRAM_BOT_TOKEN", (r"^[0-9]{5,16}:A[A-Za-z0-9_\-]{34}$",), ()),
    ("travis", "Travis CI", "TRAVIS_API_TOKEN", (r"^[a-zA-Z0-9_]{22}$",), ()),
    ("trello", "Trello", "TRELLO_API_KEY", (r"^[a-zA-Z0-9]{32}$",), ()),
    ("twitch", "Twitch", "TWITCH_CLIENT_SECRET", (r"^[a-z0-9]{30}$",), ()),
    ("typeform", "Typeform", "TYPEFORM_PERSONAL_ACCESS_TOKEN", (r"^[a-zA-Z0-9]{44}$",), ()),
    ("uptimerobot", "UptimeRobot", "UPTIMEROBOT_API_KEY", (r"^[a-zA-Z0-9]{9}-[a-zA-Z0-9]{24}$",), ()),
    ("vercel", "Vercel", "VERCEL_TOKEN", (r"^[a-zA-Z0-9]{24}$",), ()),
    ("virustotal", "VirusTotal", "VIRUSTOTAL_API_KEY", (r"^[a-f0-9]{64}$",), ()),
    ("vultr", "Vultr", "VULTR_API_KEY", (r"^[A-Z0-9]{36}$",), ()),
    ("wandb", "Weights & Biases", "WANDB_API_KEY", (r"^[0-9a-f]{40}$",), ()),
    ("webflow", "Webflow", "WEBFLOW_API_TOKEN", (r"^[a-zA-Z0-9]{64}$",), ()),
    ("yandex", "Yandex", "YANDEX_OAUTH_TOKEN", (r"^t1\.[A-Z0-9a-z_\-]+={0,2}\.[A-Z0-9a-z_\-]{86}={0,2}$", r"^YC[a-zA-Z0-9_\-]{38}$"), ()),
    ("weaviate", "Weaviate", "WEAVIATE_API_KEY", (r"^[a-zA-Z0-9]{32,}$",), ()),
    ("zendesk", "Zendesk", "ZENDESK_API_TOKEN", (r"^[a-zA-Z0-9_\-]{40}$",), ()),
    ("zerotier", "ZeroTier", "ZEROTIER_API_TOKEN", (r"^[0-9a-zA-Z]{32}$",), ()),
)


def catalogue(spark: SparkSession) -> DataFrame:
    """(ordinal, keyword, display_name, env_var, patterns, public_patterns); a pattern list is one alternation, empty if there is none."""
    rows = [(i, k, d, e, "|".join(p), "|".join(u)) for i, (k, d, e, p, u) in enumerate(SERVICES)]
    return spark.createDataFrame(rows, "ordinal int, keyword string, display_name string, env_var string, patterns string, public_patterns string")


def in_path(path: Column) -> Column:
    """Keywords that the lower-cased path contains anywhere."""
    return F.filter(F.array(*[F.lit(k) for k, *_ in SERVICES]), lambda k: F.contains(F.lower(path), k))


def service_values(spark: SparkSession, found: DataFrame, path_col: str | None = None) -> DataFrame:
    """``found`` (id, name, value, ...) joined to the services that its name's words or its path name and whose pattern its value has.

    Adds keyword, display_name, env_var, exposure (`secret`, or `public` where only a public
    pattern matches) and by_path. The catalogue has a fixed size and is broadcast. Patterns
    are held against the trimmed value in lower case. Null names, values and paths match
    nothing; repeated rows give repeated results.
    """
    words = F.array_distinct(F.coalesce(names.name_words(F.col("name")), F.array().cast("array<string>")))
    paths = F.array().cast("array<string>") if path_col is None else F.coalesce(in_path(F.col(path_col)), F.array().cast("array<string>"))
    keys = F.array_union(words, paths)
    named = found.withColumns({"normal_value": values.normalized(F.col("value")), "name_words": words}).withColumn("keyword", F.explode(keys))
    secret = F.expr("normal_value RLIKE patterns")
    public = F.expr("public_patterns <> '' AND normal_value RLIKE public_patterns")
    met = named.join(F.broadcast(catalogue(spark)), "keyword").where(secret | public)
    return met.select(
        *[found[c] for c in found.columns], "keyword", "display_name", "env_var", F.when(secret, "secret").otherwise("public").alias("exposure"), (~F.array_contains("name_words", F.col("keyword"))).alias("by_path")
    )
